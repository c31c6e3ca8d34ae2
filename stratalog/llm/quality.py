"""Text quality statistics per document, and how far each document is from the prose of its language.

Every document gets a vector of statistics over its own words (quotes of others and signature aside).
Mean and covariance of the prose of each language are estimated robustly: from medians and spreads
first, then from the documents within a distance of that, twice over; only sums and products by
language come to the driver. The Mahalanobis distance of a document and the share that each statistic
has in it are reported. Documents that are far out are the candidates for lists, tables and junk; the
exact check of what makes up most of their characters, line by line, is run on them alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import written

STATISTICS = (
    "log_words", "mean_word_length", "symbol_ratio", "line_end_punctuation", "common_word_share", "digit_ratio",
    "unique_word_share", "log_line_length", "letter_surprise", "marked_lines", "separators", "top_token_share",
)
KINDS = ("prose", "list", "table", "junk")

_ATTRIBUTION = re.compile(r"^\s*(?:.{1,60} wrote|On .{1,40} said|.{1,60} (?:schrieb|a écrit|escribió|писал\(?а?\)?))\s*:\s*$")
_QUOTED = re.compile(r"^>(?:$|[\s>]|\w)")
_TAG = re.compile(r"\[quote[^\]\n]*\]|\[/quote\]|<blockquote[^>\n]*>|</blockquote>", re.IGNORECASE)
_MARKUP = re.compile(r"\[/?(?:b|i|u|s|size|color|url|img|code|center)(?:=[^\]\n]*)?\]|</?(?:b|i|u|p|br|em|strong|a|span|div|cite|code|pre)\b[^>\n]*>|\*\*|&(?:nbsp|amp|lt|gt|quot|#\d+);", re.IGNORECASE)
_MARKUP_SIGNS = re.compile(r"[\[<&*]")
_CELL_TAG = re.compile(r"\[/?(?:table|tr|td|th)\b[^\]]*\]|</?(?:table|tr|td|th|thead|tbody)\b", re.IGNORECASE)
_ITEM_TAG = re.compile(r"\[/?list\b[^\]]*\]|\[\*\]|</?(?:ul|ol|li)\b[^>]*>", re.IGNORECASE)
_RULE = re.compile(r"^[+|][-=:+| ]{2,}[+|]$")
_BULLET = re.compile(r"^(?:[-*•–—+·▪◦‣]|\[[ xX]\]|\(?\d{1,4}[.)]|\([a-zA-Z]\)|[a-zA-Z]\)|#\d+[.:)]?)\s+\S")
_COUNTED = re.compile(r"^(?:\d+(?:[.,]\d+)?\s*\w{1,5}\s+\S+|(?:v|rev\.? ?)?\d+(?:\.\d+)+\s*:\s*\S.*|.{1,60}\s\d{1,2}:\d\d|https?://\S+)$")
_BARE = re.compile(r"^[^\W_][\w'’\-]*(?: [\w'’\-]+){0,2}(?: \(\d+\)| x ?\d+)?$")
_BASE64 = re.compile(r"^[A-Za-z0-9+/_\-]{16,}={0,2}$")
_DUMP = re.compile(r"^(?:[0-9a-fA-F]{4,16}[: ]+)?(?:[0-9a-fA-F]{2,4} +){5,}")
_PERIODIC = re.compile(r"^(.{1,8}?)\1{4,}.{0,8}$", re.DOTALL)
_MIXED_UP = re.compile(r"[Â-ô][\u0080-¿]|[Â-ô][ŒœŠšŸŽžƒˆ˜–-›€™]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ENDS = tuple(".!?…。！？:;\"”»)'’")
_KANA = re.compile(r"[぀-ヿ一-鿿]")
# Greek and Cyrillic letters that look like Latin ones, in the order of the Latin letters beside them.
_LOOKALIKES = str.maketrans("аεсеһіјӏмոорѕтυνхуαοιρ", "aecehijlmnopstuvxyaoip")


def _ends_here(line: str, rest: list[str], before: list[str]) -> bool:
    """Whether a line parts a post from its signature: two dashes, or a rule with a few short lines of words after it."""
    after = [x for x in rest if x.strip()]
    if line in ("--", "—"):
        return len(after) <= 6
    rule = len(line) >= 5 and set(line) == {"_"}
    return rule and bool(before) and 1 <= len(after) <= 3 and all(len(x) <= 80 and sum(c.isalpha() for c in x) >= 0.4 * len(x) for x in after)


def own_words(text: str) -> str:
    """A post without the quotes of others and its signature. Quotes may be nested, cut, tagged or marked line by line."""
    out, depth, at = [], 0, 0
    tags = list(_TAG.finditer(text))
    for i, tag in enumerate(tags):
        if depth == 0:
            out.append(text[at : tag.start()])
        if tag.group()[1] == "/":
            following = tags[i + 1].group()[1] if i + 1 < len(tags) else ""
            depth = max(0, depth - 1) if following == "/" else 0  # an outer quote may have been cut before its inner one ended
        elif any(t.group()[1] == "/" for t in tags[i + 1 :]):
            depth += 1
        at = tag.end()
    if depth == 0:
        out.append(text[at:])
    lines, kept, quoted = "".join(out).replace("\r", "").split("\n"), [], False
    for i, line in enumerate(lines):
        bare = line.strip()
        if _ends_here(bare, lines[i + 1 :], kept):
            break
        if _QUOTED.match(line):
            continue
        if _ATTRIBUTION.match(line):
            quoted = True
            continue
        if quoted and line.startswith("|") and not (bare.count("|") >= 3 and bare.endswith("|")):
            continue
        if bare:
            quoted = quoted and line.startswith("|")
        kept.append(line)
    return "\n".join(kept).strip("\n")


def plain_words(text: str) -> list[str]:
    """Words in lower case, without marks on letters and with look-alike letters within Latin words replaced."""
    known = _plain
    out = []
    for w in _WORD.findall(text):
        p = known.get(w)
        if p is None:
            p = w.lower()
            if not p.isascii() and any("a" <= c <= "z" for c in p):
                p = p.translate(_LOOKALIKES)
            if len(known) >= 200_000:  # a worker keeps no more
                known.clear()
            known[w] = p
        out.append(p)
    return out


_plain: dict[str, str] = {}


def bare(word: str) -> str:
    """A word without marks on its letters."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _sentence(s: str) -> bool:
    return s.endswith((".", "!", "?", "…", "。")) and len(s.split()) >= 6


def _noise(s: str) -> bool:
    """Whether a line by itself has nothing to read."""
    n = sum(not c.isspace() for c in s)
    if n < 6:
        return False
    if s.count("�") >= 0.1 * n or 2 * len(_MIXED_UP.findall(s)) >= 0.4 * n:
        return True
    readable = sum(c.isalnum() or unicodedata.category(c)[0] == "M" for c in s)
    if readable < 0.3 * n and not s.startswith(("http", "|", "+")):
        return True
    if _DUMP.match(s):
        return True
    if _BASE64.match(s) and (len(s) >= 40 or (any(c.isupper() for c in s[1:]) and any(c.islower() for c in s) and any(c.isdigit() or c in "+/" for c in s))):
        return True
    if n >= 12 and _PERIODIC.match(s.replace(" ", "")):
        return True
    tokens = s.split()
    if len(tokens) >= 6 and Counter(tokens).most_common(1)[0][1] >= 0.7 * len(tokens):
        return True
    long = [t for t in tokens if len(t) >= 4]
    mixed = sum(t.isalnum() and any(c.isdigit() for c in t) and sum(c.isalpha() for c in t) >= 2 for t in long)
    return len(tokens) >= 2 and mixed >= 2 and mixed >= 0.4 * len(tokens)


def _columns(s: str, raw: str) -> tuple[str, int] | None:
    """The delimiter and number of cells of a line that could be a row."""
    if "\t" in raw.strip():
        cells = [c for c in raw.strip().split("\t")]
        if len(cells) >= 2 and max(len(c) for c in cells) <= 40:
            return "\t", len(cells)
    for d in (";", ",", "|"):
        if d in s and d + " " not in s.replace(" " + d + " ", d):
            cells = s.replace(" " + d + " ", d).strip(d).split(d)
            if len(cells) >= 2 and all(len(c) <= 24 and len(c.split()) <= 3 for c in cells):
                return d, len(cells)
    cells = re.split(r" {2,}", s)
    if len(cells) >= 2 and all(len(c) <= 24 and len(c.split()) <= 3 for c in cells):
        return " ", 0
    return None


#: lower-case letters of the Latin, Greek and Cyrillic alphabets, by ranges of code points
ALPHABETS = ((0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x45F))
BLANK, ALPHA, DIGIT = 1, 2, 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the basic plane: the letter without case and marks, counted through ALPHABETS from 1, else 0; and the class of the sign."""
    first, base = {}, 1
    for a, b in ALPHABETS:
        first |= {c: base + c - a for c in range(a, b + 1)}
        base += b - a + 1
    letter, kind = np.zeros(0x10000, np.int64), np.zeros(0x10000, np.int8)
    for c in range(0xD800):
        x = chr(c)
        kind[c] = BLANK if x.isspace() else ALPHA if x.isalpha() else DIGIT if x.isdigit() else 0
        if kind[c] == ALPHA:
            letter[c] = first.get(ord(x.lower()[0])) or first.get(ord(unicodedata.normalize("NFD", x.lower())[0]), 0)
    return letter, kind


LETTER, CLASS = _tables()


def code_points(text: str) -> np.ndarray:
    """Code points of a text; those beyond the basic plane are 0xFFFF."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)


class Letters:
    """How surprising letters are after one another, in bits: a model of pairs of letters, counted over a whole corpus."""

    RANGES = ALPHABETS
    SIZE = 1 + sum(b - a + 1 for a, b in ALPHABETS)

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: SIZE by SIZE; every pair is taken as met once more than it was in a row of its own."""
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.bits = -np.log2(share)
        self.bits[0, :] = self.bits[:, 0] = np.nan
        #: half way from the bits of the corpus itself to those of letters drawn at random from one alphabet
        self.odd = (float(np.nansum(self.bits * counts)) / max(1.0, float(counts.sum())) + self._random(counts)) / 2

    def _random(self, counts: np.ndarray) -> float:
        total, bits, base = 0.0, 0.0, 1
        for a, b in self.RANGES:
            own = slice(base, base + b - a + 1)
            n = float(counts[own, own].sum())
            total, bits = total + n, bits + n * float(self.bits[own, own].mean())
            base += b - a + 1
        return bits / total if total else np.log2(self.SIZE)

    @classmethod
    def codes(cls, text: str) -> np.ndarray:
        return LETTER[code_points(text)]

    @classmethod
    def count(cls, text: str) -> np.ndarray:
        """Pairs of neighbouring letters in a text, by first * SIZE + second; those with another sign are left out."""
        at = cls.codes(text)
        pairs = at[:-1] * cls.SIZE + at[1:]
        return np.bincount(pairs[(at[:-1] > 0) & (at[1:] > 0)], minlength=cls.SIZE**2)

    def surprise(self, text: str | np.ndarray) -> float:
        """Mean bits of the pairs of letters of a text or its code points; 0 where it has fewer than three."""
        at = self.codes(text) if isinstance(text, str) else LETTER[text]
        bits = self.bits[at[:-1], at[1:]]
        bits = bits[~np.isnan(bits)]
        return float(bits.mean()) if len(bits) > 2 else 0.0


def count_letters(df: DataFrame, text: str = "text") -> Letters:
    """The model of pairs of letters over all texts: counted a partition at a time, at most SIZE squared rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(Letters.SIZE**2, np.int64)
        for b in batches:
            total += Letters.count("\n".join(x for x in b.column(0).to_pylist() if x))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["pair", "n"])

    counts = np.zeros(Letters.SIZE**2)
    for r in df.select(text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    return Letters(counts.reshape(Letters.SIZE, Letters.SIZE))


def _gibberish(s: str, common: frozenset[str], letters: Letters) -> bool:
    """Whether a line in letters has next to no common word and letters that do not follow one another."""
    tokens = [t.strip(".,!?:()[]\"'*_").lower() for t in s.split() if "://" not in t and "www." not in t]
    words = [bare(t) for t in tokens if t and (t[0].isascii() or bare(t)[0].isascii()) and any(c.isalpha() for c in t)]
    if len(words) < 4 or sum(len(w) > 1 and w in common for w in words) >= 0.06 * len(words) + 1e-9:
        return False
    return letters.surprise(" ".join(words)) >= letters.odd


def line_kinds(text: str, common: frozenset[str], letters: Letters) -> list[tuple[str, str]]:
    """The lines of a text, blank ones left out, with their kind."""
    raw = [x for x in text.split("\n") if x.strip()]
    lines = [_MARKUP.sub("", x).strip() for x in raw]
    kinds = [""] * len(lines)
    tokens = text.split()
    if len(tokens) >= 8 and Counter(tokens).most_common(1)[0][1] >= 0.7 * len(tokens):
        return [(x, "junk") for x in raw]
    rows: Counter = Counter()
    layout: list[tuple[str, int] | None] = [None] * len(lines)
    for i, s in enumerate(lines):
        if _CELL_TAG.search(s):
            kinds[i] = "table"
        elif _RULE.match(s) or (s.startswith("|") and s.count("|") >= 3 and s.endswith("|")):
            kinds[i] = "table"
        elif _ITEM_TAG.search(s):
            kinds[i] = "prose" if _sentence(_ITEM_TAG.sub("", s).strip()) else "list"
        elif _noise(s):
            kinds[i] = "junk"
        elif _BULLET.match(s):
            kinds[i] = "prose" if _sentence(s) else "list"
        else:
            layout[i] = _columns(s, raw[i])
            if layout[i]:
                rows[layout[i]] += 1
    for i, where in enumerate(layout):
        if where and rows[where] >= 3:
            kinds[i] = "table"
    # items without marks: at least three short lines in a row
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and not kinds[j] and len(lines[j]) <= 80 and (_COUNTED.match(lines[j]) or (len(lines[j]) <= 32 and _BARE.match(lines[j]))):
            j += 1
        if j - i >= 3:
            kinds[i:j] = ["list"] * (j - i)
        i = max(j, i + 1)
    # what is left is prose unless its words are none: a long line by itself, short ones together
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and not kinds[j] and (j == i or len(lines[j]) < 40 > len(lines[i])):
            j += 1
        if j > i:
            kinds[i:j] = ["junk" if _gibberish(" ".join(lines[i:j]), common, letters) else "prose"] * (j - i)
        i = max(j, i + 1)
    for i in range(len(lines) - 1):
        if lines[i].endswith(":") and len(lines[i].split()) <= 4 and kinds[i] == "prose" and kinds[i + 1] in ("list", "table"):
            kinds[i] = kinds[i + 1]
        elif kinds[i] == "prose" and kinds[i + 1] == "list" and len(lines[i].split()) <= 3 and not lines[i].endswith(_ENDS) and (i == 0 or kinds[i - 1] != "prose"):
            kinds[i] = "list"
    return list(zip(raw, kinds))


def language(text: str, words: list[str], by_language: dict[str, frozenset[str]]) -> str:
    """The language by script and common words; '' where neither tells."""
    if len(_KANA.findall(text)) >= 0.2 * max(1, len(text)):
        return "ja"
    best, most = "", 0
    counts = Counter(words)
    for name, known in sorted(by_language.items()):
        n = sum(counts[w] for w in counts.keys() & known)
        if n > most:
            best, most = name, n
    return best


_SEPARATORS = re.compile(r"\t|\||;|,(?! )|(?<=\S) {2,}(?=\S)")
_MARKED = re.compile(r"\s*(?:[^\w\s\"'“«(¿¡@]|\(?\w{1,3}[.):])")


@dataclass
class Words:
    """What texts are held against: common words by language and of all languages, and the letters."""

    by_language: dict[str, frozenset[str]]
    every: frozenset[str]
    letters: Letters


def describe(own: str, known: Words) -> tuple[str, int, list[float]]:
    """Language, word count and statistics in the order of STATISTICS of a post's own words."""
    words = plain_words(own)
    lang = language(own, words, known.by_language)
    points = code_points(own)
    blanks, letters, digits = np.bincount(CLASS[points], minlength=4)[1:].tolist()
    chars = len(points) - blanks
    if not chars:
        return lang, 0, [0.0] * len(STATISTICS)
    lines = [x for x in own.split("\n") if x.strip()]
    ends = [x.rstrip() if x.rstrip().endswith(_ENDS) or not _MARKUP_SIGNS.search(x) else _MARKUP.sub("", x).rstrip() for x in lines]
    common_words = known.by_language.get(lang, known.every)
    if lang == "ja":
        kana = sum(own.count(w) * len(w) for w in common_words)
        common = min(1.0, kana / chars)
    else:
        common = sum(n for w, n in Counter(words).items() if w in common_words or (not w.isascii() and bare(w) in common_words)) / len(words) if words else 0.0
    tokens = own.split()
    statistics = [
        float(np.log1p(len(words))),
        sum(map(len, words)) / len(words) if words else 0.0,
        (chars - letters - digits) / chars,
        sum(x.endswith(_ENDS) for x in ends) / len(ends),
        common,
        digits / chars,
        len(set(words)) / len(words) if words else 0.0,
        float(np.log1p(chars / len(lines))),
        known.letters.surprise(points),
        sum(len(x) for x in lines if _MARKED.match(x)) / sum(map(len, lines)),
        len(_SEPARATORS.findall("\n".join(lines))) / chars,
        Counter(tokens).most_common(1)[0][1] / len(tokens) if len(tokens) >= 8 else 0.0,
    ]
    return lang, len(words), statistics


def line_shares(own: str, known: Words) -> list[float]:
    """Shares of the characters in lines of each of KINDS."""
    sizes: Counter = Counter()
    for line, kind in line_kinds(own, known.every, known.letters):
        sizes[kind] += len(line.strip())
    total = sum(sizes.values())
    return [sizes[k] / total if total else 0.0 for k in KINDS]


def collect_words(common_words: DataFrame, letters: Letters) -> Words:
    """The table of common words, which must have at most 100,000 rows, with the model of letters."""
    rows = common_words.select("lang", F.lower("word").alias("word")).filter("lang is not null and word is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 common words")
    by_language: dict[str, set] = {}
    for r in rows:
        by_language.setdefault(r["lang"].lower(), set()).add(r["word"])
    frozen = {k: frozenset(v) for k, v in by_language.items()}
    return Words(frozen, frozenset(w for k, v in frozen.items() if k != "ja" for w in v), letters)


_DESCRIBED = "doc_id bigint, language string, word_count bigint, statistics array<double>"


def document_statistics(df: DataFrame, known: Words, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, language, word_count and statistics of every row (see ``describe``), and its own words.

    Whole texts are read. Null, empty and blank texts have 0 words and zeros; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [own_words(t) if t else "" for t in b.column(1).to_pylist()]
            found = [describe(x, known) for x in own]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(own, pa.string())], ["doc_id", "language", "word_count", "statistics", "own"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _DESCRIBED + ", own string")


def _moments(df: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Number, mean and covariance of the statistics by language, from sums and products."""
    k = len(STATISTICS)
    x = [F.col("statistics")[i] for i in range(k)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in df.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():  # a row a language
        n = float(r["n"])
        mean = np.array([r[f"s{i}"] for i in range(k)]) / n
        cov = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mean[i] * mean[j]
        out[r["language"]] = (n, mean, cov)
    return out


#: the least spread of a statistic, so that one that is constant in prose doesn't divide by nothing
FLOOR = np.array([0.3, 0.2, 0.01, 0.05, 0.03, 0.01, 0.05, 0.2, 0.1, 0.05, 0.005, 0.03])
Model = dict[str, tuple[np.ndarray, np.ndarray]]


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov + np.diag(FLOOR**2))


def _parts(described: pa.RecordBatch, model: Model) -> np.ndarray:
    """The parts of the statistics in the squared distance of every row."""
    x = described.column(3).flatten().to_numpy().reshape(-1, len(STATISTICS))
    parts = np.zeros_like(x)
    names = np.array([n if n in model else "" for n in described.column(1).to_pylist()], object)
    for name in set(names.tolist()):
        at = names == name
        mean, inverse = model[name]
        d = x[at] - mean
        parts[at] = d * (d @ inverse)
    return parts


def _distances(df: DataFrame, model: Model) -> DataFrame:
    """Adds ``distance`` (squared) to described documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_parts(b, model).sum(axis=1), pa.float64())], [*b.schema.names, "distance"])

    return df.mapInArrow(run, _DESCRIBED + ", distance double")


def fit_prose(described: DataFrame, steps: int = 2, within: float = 25.0, least: int = 50) -> Model:
    """Robust mean and inverse covariance of the prose of every language.

    Begins with medians and half the distance of the 16th and 84th percentile of every statistic, then
    takes the documents within a squared distance of ``within`` to estimate mean and covariance, ``steps``
    times. Languages of under ``least`` documents, and documents of none, share one model, under ''.
    """
    some = described.filter("word_count > 0")
    some = some.unionByName(some.withColumn("language", F.lit("*")))
    k = len(STATISTICS)
    middle = [F.percentile_approx(F.col("statistics")[i], F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)), 1000).alias(f"q{i}") for i in range(k)]
    model: Model = {}
    for r in some.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *middle).collect():  # a row a language
        if r["n"] >= least or r["language"] == "*":
            q = np.array([r[f"q{i}"] for i in range(k)])
            model[r["language"]] = (q[:, 1], _inverse(np.diag(((q[:, 2] - q[:, 0]) / 2) ** 2)))
    if "*" not in model:
        return {"": (np.zeros(k), np.eye(k))}
    model[""] = model["*"]
    for _ in range(steps):
        near = _distances(some, model).filter(F.col("distance") <= within)
        found = _moments(near)
        for name, (n, mean, cov) in found.items():
            if name in model and n >= min(least, 20):
                model[name] = (mean, _inverse(cov))
        model[""] = model["*"]
    return model


#: the 0.999 quantile of the chi-squared distribution with as many degrees of freedom as there are statistics
FAR = 32.91


def text_quality(df: DataFrame, common_words: DataFrame, far: float = FAR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Statistics, distance and kind of every document.

    Columns: doc_id, language, word_count, mean_word_length, symbol_ratio, line_end_punctuation,
    common_word_share, distance (squared Mahalanobis distance from the prose of the language),
    contributions (map of statistic to its part of the distance), shares (of characters by kind of line, in
    the order of KINDS), kind. A document whose distance is over ``far`` is checked line by line: it is list,
    table or junk if lines of that kind have most of its own characters. All others are prose and have null
    shares, blank, empty and null texts among them. Tables without rows give none.
    """
    known = collect_words(common_words, count_letters(df, text))
    described = written(document_statistics(df, known, text, doc_id))  # own words too: they cost more to find again than to keep
    model = fit_prose(described.drop("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(4).to_pylist()
            parts = _parts(b, model)
            distance = parts.sum(axis=1)
            shares = [line_shares(x, known) if d > far and n else None for x, d, n in zip(own, distance, map(str.strip, own))]
            kinds = [next((k for k, x in zip(KINDS, s) if x > 0.5 and k != "prose"), "prose") if s else "prose" for s in shares]
            offsets = pa.array(np.arange(len(own) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(distance, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(parts.ravel(), pa.float64())), pa.array(shares, pa.list_(pa.float64())), pa.array(kinds, pa.string())],
                [*b.schema.names[:4], "distance", "parts", "shares", "kind"],
            )

    placed = described.mapInArrow(run, _DESCRIBED + ", distance double, parts array<double>, shares array<double>, kind string")
    at = {n: F.col("statistics")[STATISTICS.index(n)].alias(n) for n in ("mean_word_length", "symbol_ratio", "line_end_punctuation", "common_word_share")}
    names = F.array(*[F.lit(n) for n in STATISTICS])
    return placed.select("doc_id", "language", "word_count", *at.values(), "distance", F.map_from_arrays(names, "parts").alias("contributions"), "shares", "kind")
