"""Log lines of mixed layouts into entries with timestamp, level, component and message.

Every line is cut into typed tokens (stamps, levels, numbers, marks, words and so on). Bigrams and
trigrams of tokens are counted over all lines, distributed, and make two dictionaries: words that
are constant in their context (they fill nearly all of its occurrences), and the trigrams of types
that are frequent at all. With them a line becomes a template: constant words stay, variable ones are
slots, and so are typed tokens. Roles are given to the slots of a template, once for all its lines, by
their types: a stamp is the time of the entry, a level word its level, a variable name between
delimiters its component; a template starts entries if it has a stamp or a level in its head, and if
the trigrams of its head are all in the dictionary. Lines of other templates belong to the entry
before them.
"""

from __future__ import annotations

import calendar
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.session import cut

# Spellings of levels, severities of syslog, letters of month names and levels.
LEVELS = {
    "trace": "TRACE", "debug": "DEBUG", "dbg": "DEBUG", "info": "INFO", "information": "INFO", "notice": "INFO",
    "warn": "WARN", "warning": "WARN", "err": "ERROR", "error": "ERROR", "severe": "ERROR", "crit": "FATAL",
    "critical": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL", "panic": "FATAL", "fatal": "FATAL",
}
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
LETTERS = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_NO = {m: i + 1 for i, m in enumerate(MONTHS)}

_CLOCK = r"\d{2}:\d{2}:\d{2}"
_MONTH = "(?:" + "|".join(MONTHS) + ")"
TOKEN = re.compile(
    "|".join(
        f"(?P<{name}>{pattern})"
        for name, pattern in (
            ("pri", r"^<\d{1,3}>"),
            ("glog", rf"^[TDIWEFC]\d{{4}} {_CLOCK}(?:\.\d+)?"),
            ("iso", rf"(?<![\w/])\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}(?:[.,]\d{{1,9}})?(?:Z|[+-]\d{{2}}:?\d{{2}})?(?!\w)"),
            ("slash", rf"(?<![\w/])\d{{4}}/\d{{2}}/\d{{2}} {_CLOCK}(?:[.,]\d{{1,9}})?"),
            ("dotted", rf"(?<![\w.])\d{{2}}\.\d{{2}}\.\d{{4}} {_CLOCK}(?:[.,]\d{{1,9}})?(?![\w])"),
            ("compact", r"(?<![\w.])(?:19|20)\d{6}T\d{6}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?(?!\w)"),
            ("clf", rf"(?<!\w)\d{{2}}/{_MONTH}/\d{{4}}:{_CLOCK}(?: [+-]\d{{4}})?"),
            ("ctime", rf"(?<!\w)[A-Z][a-z]{{2}} {_MONTH} [ \d]\d {_CLOCK}(?:\.\d+)? \d{{4}}"),
            ("bsd", rf"(?<!\w){_MONTH} [ \d]\d {_CLOCK}(?:\.\d+)?"),
            ("ip", r"(?<![\w.:])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7})(?![\w.:])"),
            ("epoch", r"(?<![\w.])1\d{9}(?:\.\d{1,9}|\d{3})(?![\w.])"),
            ("string", r'"(?:[^"\\]|\\.)*"'),
            ("level", r"(?<![\w.-])(?i:" + "|".join(sorted(LEVELS, key=len, reverse=True)) + r")\d*(?![\w.-])"),
            ("number", r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"),
            ("numbered", r"[A-Za-z_]\w*(?:[.\-]\w+)*?-\d+(?![\w.\-])"),
            ("word", r"\w+(?:[.\-]\w+)*"),
            ("mark", r"[^\w\s]"),
        )
    ),
)
STAMPS = ("iso", "slash", "dotted", "compact", "clf", "ctime", "bsd", "glog", "epoch")
ONLY_STAMP = re.compile(rf"(?P<iso>\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}(?:[.,]\d{{1,9}})?(?:Z|[+-]\d{{2}}:?\d{{2}})?)|(?P<epoch>1\d{{9}}(?:\.\d{{1,9}}|\d{{3}}))")
ONLY_LEVEL = re.compile(r"(" + "|".join(LEVELS) + r")\d*", re.IGNORECASE)
#: what may stand between a component and what follows it
DELIMITERS = {":", "]", ")", "[", "-", "(", "number"}


def level_of(word: str) -> str:
    """The level that a level word stands for; digits after it are dropped."""
    return LEVELS[word.rstrip("0123456789").lower()]


def _clock_ms(part: str) -> int:
    """Milliseconds of ``HH:MM:SS`` with an optional fraction, which is cut."""
    whole, _, fraction = part.replace(",", ".").partition(".")
    h, m, s = whole.split(":")
    return (int(h) * 3600 + int(m) * 60 + int(s)) * 1000 + int((fraction + "000")[:3])


def _day_ms(year: int, month: int, day: int) -> int:
    return calendar.timegm((year, month, day, 0, 0, 0)) * 1000


def _zone_ms(zone: str) -> int:
    if not zone or zone == "Z":
        return 0
    digits = zone[1:].replace(":", "")
    return (1 if zone[0] == "+" else -1) * (int(digits[:2]) * 60 + int(digits[2:4])) * 60_000


_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ]([\d:]{8}(?:[.,]\d+)?)(Z|[+-]\d\d:?\d\d)?")

_COMPACT = re.compile(r"T(\d{6}(?:[.,]\d+)?)(Z|[+-]\d\d:?\d\d)?")


def stamp_ms(kind: str, text: str, year: int) -> int:
    """Milliseconds since 1970 of a stamp token; ``year`` serves layouts without one; -1 if it is no date."""
    try:
        if kind == "iso":
            y, mo, d, clock, zone = _ISO.fullmatch(text).groups()
            return _day_ms(int(y), int(mo), int(d)) + _clock_ms(clock) - _zone_ms(zone or "")
        if kind == "slash":
            return _day_ms(int(text[:4]), int(text[5:7]), int(text[8:10])) + _clock_ms(text[11:])
        if kind == "dotted":
            return _day_ms(int(text[6:10]), int(text[3:5]), int(text[:2])) + _clock_ms(text[11:])
        if kind == "compact":
            clock, zone = _COMPACT.fullmatch(text[8:]).groups()
            return _day_ms(int(text[:4]), int(text[4:6]), int(text[6:8])) + _clock_ms(f"{clock[:2]}:{clock[2:4]}:{clock[4:]}") - _zone_ms(zone or "")
        if kind == "clf":
            day = _day_ms(int(text[7:11]), MONTH_NO[text[3:6]], int(text[:2]))
            return day + _clock_ms(text[12:20]) - _zone_ms(text[21:])
        if kind == "ctime":
            return _day_ms(int(text[-4:]), MONTH_NO[text[4:7]], int(text[8:10])) + _clock_ms(text[11:-5])
        if kind == "bsd":
            return _day_ms(year, MONTH_NO[text[:3]], int(text[4:6])) + _clock_ms(text[7:])
        if kind == "glog":
            return _day_ms(year, int(text[1:3]), int(text[3:5])) + _clock_ms(text[6:])
        if "." in text:
            whole, fraction = text.split(".")
            return int(whole) * 1000 + int((fraction + "000")[:3])
        return int(text)
    except (ValueError, KeyError, AttributeError):
        return -1


Token = tuple[str, str, int, int]  # type, text, start, end; a mark's type is the mark itself


def tokens(line: str) -> list[Token]:
    """Typed tokens of a line."""
    return [(m.group() if m.lastgroup == "mark" else m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(line)]


def head_tokens(line: str) -> tuple[list[Token], bool]:
    """Tokens up to the first free word and the one after it, and whether that was the whole line.

    A free word stands in no brackets, is no value of a key and has no delimiter behind it: no role can come later.
    """
    out: list[Token] = []
    host = stamped = False
    for m in TOKEN.finditer(line):
        kind = m.group() if m.lastgroup == "mark" else m.lastgroup
        out.append((kind, m.group(), m.start(), m.end()))
        if len(out) < 2:
            host = kind == "pri"
            continue
        was = out[-2]
        stamped = stamped or was[0] in STAMPS
        if was[0] in ("word", "numbered", "level"):
            before = out[-3][0] if len(out) > 2 else "^"
            close = was[3] == m.start()
            if host and stamped:
                host = False  # the machine's name
            elif was[0] != "level" and before not in ("[", "(", "=") and not (close and kind == "=") and not (kind in DELIMITERS and (close or kind in ("-", "number"))):
                return out, False
    return out, True


def _kind(token: Token) -> str:
    return "stamp" if token[0] in STAMPS else token[0]


def _kinds(parts: list[Token], line: str, whole: bool = True) -> list[str]:
    """Types of the tokens, with the start and end of the line and a mark for indentation."""
    return [">" if line[:1].isspace() else "^", *map(_kind, parts), *(["$"] if whole else [])]


def members(line: str) -> list[tuple[str, str, object]] | None:
    """Name, type and value of the members of a line that is one JSON object; None for others."""
    try:
        found = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    out = []
    for name, value in found.items():
        text = value if isinstance(value, str) else json.dumps(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else ""
        if text and (m := ONLY_STAMP.fullmatch(text)):
            out.append((name, m.lastgroup, text))
        elif not isinstance(value, str) or not text:
            out.append((name, "number" if text else "other", text))
        else:
            out.append((name, "level" if ONLY_LEVEL.fullmatch(text) else "name" if _NAME.fullmatch(text) else "text", text))
    return out


_NAME = re.compile(r"\w[\w.\-]*")


def ngrams(line: str) -> Iterator[tuple[str, str, str, bool]]:
    """Trigrams (type before, token, type after) of a line, and bigrams (type before, word, '') of its words; the mark tells words.

    Tokens are words as written and types of all others. Members of JSON objects are a word, the name, and the type of the value.
    """
    if line[:1] == "{" and (found := members(line)) is not None:
        before = "{"
        for name, kind, _ in found:
            kind = "stamp" if kind in STAMPS else kind
            yield before, name, kind, True
            yield "word", kind, "", False
            before = kind
        return
    parts = tokens(line)
    kinds = _kinds(parts, line)
    for i, p in enumerate(parts):
        if p[0] == "word":
            yield kinds[i], p[1], kinds[i + 2], True
            yield kinds[i], p[1], "", True
        else:
            yield kinds[i], kinds[i + 1], kinds[i + 2], False


@dataclass
class Parsed:
    """An entry's head; ``start`` says whether the line starts an entry at all."""

    start: bool = False
    ts_ms: int = -1
    level: str = ""
    component: str = ""
    message: str = ""
    request: str | None = None
    user_agent: str | None = None
    template: str = ""


@dataclass(frozen=True)
class Roles:
    """What the slots of a template are: numbers of tokens, or -1. ``last`` is the last token that a role needs."""

    start: bool = False
    stamp: int = -1
    level: int = -1
    component: int = -1
    body: int = -1
    last: int = -1


#: between the symbols of a template; a symbol that follows a space begins with one
GLUE = "\t"
SLOT = "<*>"


def shown(template: str) -> str:
    """A template as one reads it."""
    return template.replace(GLUE, "")


@dataclass
class Layouts:
    """The dictionaries of n-grams, and the roles of the templates met so far."""

    constants: set[tuple[str, str, str]] = field(default_factory=set)
    frequent: set[tuple[str, str, str]] = field(default_factory=set)
    roles: dict[str, Roles] = field(default_factory=dict)

    def constant(self, before: str, word: str, after: str) -> bool:
        return (before, word, after) in self.constants or (before, word, "") in self.constants

    def template(self, parts: list[Token], kinds: list[str]) -> str:
        """Constant words and marks as they are, slots for variable words and typed tokens."""
        out, end = [kinds[0]], 0
        for i, (kind, text, start, stop) in enumerate(parts):
            if kind == "word":
                symbol = text if i + 2 < len(kinds) and self.constant(kinds[i], text, kinds[i + 2]) else SLOT
            else:
                symbol = f"<{kind}>" if len(kind) > 1 else kind
            out.append(" " + symbol if start > end and i else symbol)
            end = stop
        if len(kinds) > len(parts) + 1:
            out.append("$")
        return GLUE.join(out)

    def parse(self, line: str, year: int) -> Parsed:
        """Roles for one line. Empty and blank lines, and indented ones, start no entry."""
        if not line or line[0].isspace():
            return Parsed()
        if line[0] == "{":
            return self._record(line, year)
        parts, whole = head_tokens(line)
        if not parts:
            return Parsed()
        if parts[0][0] == "ip":
            parts, whole = tokens(line), True
        kinds = _kinds(parts, line, whole)
        template = self.template(parts, kinds)
        roles = self.roles_of(template)
        if not roles.start:
            return Parsed()
        out = Parsed(True, template=template)
        if roles.stamp >= 0:
            kind, text = parts[roles.stamp][:2]
            out.ts_ms = stamp_ms(kind, text, year)
            if out.ts_ms < 0:
                return Parsed()  # no date
            if kind == "glog":
                out.level = LETTERS[text[0]]
        if roles.level >= 0:
            kind, text = parts[roles.level][:2]
            out.level = SEVERITIES[int(text[1:-1]) % 8] if kind == "pri" else level_of(text)
        if roles.component >= 0:
            out.component = parts[roles.component][1]
        if kinds[1] == "ip":
            strings = [p[1][1:-1] for p in parts[roles.stamp :] if p[0] == "string"]
            out.message = out.request = strings[0]
            out.user_agent = strings[-1] if len(strings) > 1 else None
        elif roles.body >= 0:
            kind, text, start, _ = parts[roles.body]
            out.message = text[1:-1].replace('\\"', '"') if kind == "string" else line[start:]
        return out

    def roles_of(self, template: str) -> Roles:
        """The roles of a template's slots, worked out once; none where a trigram of its head is not in the dictionary."""
        found = self.roles.get(template)
        if found is None:
            symbols = template.split(GLUE)
            kinds = [_symbol_kind(x) for x in symbols]
            found = _access_roles(kinds) if kinds[1] == "ip" else _plain_roles([x.lstrip(" ") for x in symbols], kinds, [x.startswith(" ") for x in symbols])
            if found.start and not self.known(kinds, found.last + 1):
                found = Roles()
            if len(self.roles) > 100_000:  # a worker keeps no more
                self.roles.clear()
            self.roles[template] = found
        return found

    def known(self, kinds: list[str], upto: int) -> bool:
        return all((kinds[i - 1], kinds[i], kinds[i + 1]) in self.frequent for i in range(1, upto + 1) if i + 1 < len(kinds))

    def _record(self, line: str, year: int) -> Parsed:
        """One JSON object: the names of its members are the words of its template, and roles go by the type of their values."""
        found = members(line)
        if not found:
            return Parsed()
        kinds = ["{"]
        for _, kind, _ in found:
            kinds += ["word", "stamp" if kind in STAMPS else kind]
        symbols = ["{"]
        for i, (name, kind, _) in enumerate(found):
            symbols += [name if self.constant(kinds[2 * i], name, kinds[2 * i + 2]) else SLOT, f"<{kind}>"]
        out, names, texts = Parsed(template=GLUE.join(symbols)), [], []
        for _, kind, text in found:
            if kind in STAMPS and out.ts_ms < 0:
                out.ts_ms = stamp_ms(kind, text, year)
            elif kind == "level" and not out.level:
                out.level = level_of(text)
            elif kind in ("name", "level"):
                names.append(text)
            elif kind == "text":
                texts.append(text)
        known = all((kinds[i - 1], kinds[i], kinds[i + 1] if i % 2 else "") in self.frequent for i in range(1, len(kinds)))
        out.start = known and (out.ts_ms >= 0 or (bool(out.level) and bool(texts or names)))
        if not out.start:
            return Parsed()
        out.component = names[0] if names else ""
        out.message = texts[0] if texts else names[1] if len(names) > 1 else ""
        return out


def _symbol_kind(symbol: str) -> str:
    symbol = symbol.lstrip(" ")
    if symbol == SLOT:
        return "word"
    if len(symbol) > 2 and symbol[0] == "<" and symbol[-1] == ">":
        return "stamp" if symbol[1:-1] in STAMPS else symbol[1:-1]
    return "word" if symbol[0].isalnum() or symbol[0] == "_" else symbol


def _access_roles(kinds: list[str]) -> Roles:
    """A line of an access log: address, two names, stamp in brackets, then quoted pieces up to the end."""
    at = next((i for i, k in enumerate(kinds) if k == "stamp"), -1)
    if at < 0 or at > 9 or kinds[at - 1] != "[" or kinds[-2] != "string":
        return Roles()
    return Roles(True, at - 1, last=at - 1)


def _plain_roles(symbols: list[str], kinds: list[str], spaced: list[bool]) -> Roles:
    """Roles by the types of slots and the marks around them; the head ends where free text starts."""
    stamp, level, component, body, start = -1, -1, -1, -1, False
    n = len(kinds)
    host = kinds[1] == "pri"
    glog, last, spare = False, 0, -1
    if host:
        level = 0
    for i in range(1, n - (kinds[-1] == "$")):
        kind, before = kinds[i], kinds[i - 1]
        after = kinds[i + 1] if i + 1 < n else ""
        close = i + 1 < n and after != "$" and not spaced[i + 1]
        if kind == "stamp":
            if stamp < 0:
                stamp, start, last = i - 1, True, i - 1
                glog = symbols[i] == "<glog>"
            continue
        if kind == "level" and level < 0 and not glog and (start or i == 1 or before in ("[", "(", "=")):
            if i == 1 and not (close and after in (":", "]")):
                break
            level, last = i - 1, i - 1
            start = start or (i == 1 and after == ":") or (i == 2 and before == "[" and after == "]")
            continue
        if kind == "string" and before == "=":
            body = i - 1 if body < 0 else body
            continue
        if kind not in ("word", "numbered", "level"):
            continue
        if host and stamp >= 0:
            host = False  # the machine's name follows the stamp
            continue
        if after == "=" and close:
            if before in ("^", "stamp", "level", "word", "numbered", "string") and body < 0:
                continue  # a key of key=value
            break
        if kind == "numbered":
            if before in ("[", "("):
                continue
            body = i - 1 if body < 0 else body
            break
        if before == "=" and component < 0:
            component = last = i - 1
            continue
        if not start and level < 0:
            break  # free text before any stamp or level
        if before in ("[", "(") and kind == "word" and symbols[i] != SLOT:
            if after in ("]", ")") and spare < 0:
                spare = i - 1
            continue  # a constant word: the name of what follows, or of the only component there is
        if component < 0 and after in DELIMITERS and (close or after in ("-", "number")):
            component = last = i - 1
            continue
        body = i - 1 if body < 0 else body
        break
    if component < 0:
        component, last = spare, max(last, spare)
    return Roles(start, stamp, level, component, body, last) if start else Roles()


NGRAMS = "before string, token string, after string, word boolean, n bigint"


def _count_ngrams(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        cols = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))]
        out = pa.RecordBatch.from_arrays([*cols, pa.array([counts[k] for k in keys], pa.int64())], ["before", "token", "after", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                for line in text.split("\n"):
                    counts.update(ngrams(line))
                    if len(counts) > most:
                        yield flush()
    if counts:
        yield flush()


def ngram_counts(texts: DataFrame) -> DataFrame:
    """Bigrams and trigrams of all lines of the one column of ``texts`` (NGRAMS), counted per partition and merged."""
    partial = texts.mapInArrow(_count_ngrams, NGRAMS)
    return partial.groupBy("before", "token", "after", "word").agg(F.sum("n").alias("n"))


def layout_constants(counts: DataFrame, share: float = 0.75, least: int = 20) -> DataFrame:
    """Words that are constant in their context, of the n-grams in ``counts``.

    A word is constant where it fills at least ``share`` of a context met at least ``least`` times. Result:
    before, token, after, n; one word a context at most, and contexts are pairs of token types and marks.
    """
    context = counts.filter("word").groupBy("before", "after").agg(F.sum("n").alias("total"), F.max(F.struct("n", "token")).alias("top"))
    return context.filter((F.col("total") >= least) & (F.col("top.n") >= share * F.col("total"))).select(
        "before", F.col("top.token").alias("token"), "after", F.col("top.n").alias("n")
    )


def frequent_trigrams(counts: DataFrame, share: float = 1e-5) -> DataFrame:
    """Trigrams of types that make up at least ``share`` of all: before, token, after, n. At most 1 / share rows."""
    types = counts.filter("not word or after <> ''").groupBy("before", F.when(F.col("word"), "word").otherwise(F.col("token")).alias("token"), "after").agg(F.sum("n").alias("n"))
    return types.filter(F.col("n") >= F.lit(share) * types.agg(F.sum("n").alias("every")).scalar())


def learn_layouts(texts: DataFrame, share: float = 0.75, least: int = 20, support: float = 1e-5) -> Layouts:
    """The dictionaries as the driver keeps them: one word a context and at most 1 / ``support`` trigrams, whatever the input."""
    counts = cut(ngram_counts(texts))
    triple = lambda df: {(r["before"], r["token"], r["after"]) for r in df.collect()}
    return Layouts(triple(layout_constants(counts, share, least)), triple(frequent_trigrams(counts, support)))


PARSED = "start boolean, ts_ms bigint, log_level string, component string, message string, request string, user_agent string, template string"
_PARSED_ARROW = [
    ("start", pa.bool_()), ("ts_ms", pa.int64()), ("log_level", pa.string()), ("component", pa.string()),
    ("message", pa.string()), ("request", pa.string()), ("user_agent", pa.string()), ("template", pa.string()),
]


def _columns(parsed: list[Parsed]) -> list[pa.Array]:
    values = zip(*((p.start, p.ts_ms, p.level, p.component, p.message, p.request, p.user_agent, p.template) for p in parsed))
    return [pa.array(list(v), t) for v, (_, t) in zip(values, _PARSED_ARROW)] if parsed else [pa.array([], t) for _, t in _PARSED_ARROW]


def parse_lines(df: DataFrame, text: str, year: str, layouts: Layouts) -> DataFrame:
    """Adds the parsed head of the first line of ``text`` to every row (columns of PARSED).

    ``year`` is an integer column for layouts without a year; where it is null they get 1970.
    Null text starts no entry.
    """
    keep = [c for c in df.columns if c not in (text, year)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            years = b.column(names.index(year)).to_pylist()
            found = []
            for t, y in zip(b.column(names.index(text)).to_pylist(), years):
                head, newline, rest = (t or "").partition("\n")
                p = layouts.parse(head, y or 1970)
                if p.start and newline:
                    p.message += newline + rest
                found.append(p)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(names.index(c)) for c in keep), *_columns(found)], [*keep, *(n for n, _ in _PARSED_ARROW)]
            )

    return df.select(*keep, text, year).mapInArrow(run, schema)


def line_templates(lines: DataFrame, text: str, layouts: Layouts) -> DataFrame:
    """Templates of the lines that start entries, as one reads them, and the number of such lines: template, n."""
    parsed = parse_lines(lines.select(text, F.lit(1970).alias("__year")), text, "__year", layouts)
    whole = F.regexp_replace("template", GLUE, "").alias("template")
    return parsed.filter("start").groupBy(whole).agg(F.count(F.lit(1)).alias("n"))


def assemble_entries(lines: DataFrame, with_text: bool = False) -> DataFrame:
    """Entries of parsed lines: stream, first_id, last_id, ts_ms, log_level, component (and message, ...).

    ``lines`` has log_message_id, stream, file_no, line_no and PARSED (and ``text`` with ``with_text``,
    which gives the whole text of the entry and adds the texts of its later rows to its message).
    Copies of a line count once. Lines are put in order
    within a file; a file that opens with lines of an entry of an earlier file is joined to that one
    over a summary of one row a file, so no task gets a whole stream. Lines before the first entry
    of a stream belong to none.
    """
    in_file = Window.partitionBy("stream", "file_no").orderBy("line_no", "log_message_id")
    once = lines.withColumn("__before", F.lag("log_message_id").over(in_file)).filter(
        F.col("__before").isNull() | (F.col("__before") != F.col("log_message_id"))
    )
    marked = once.withColumn("first_id", F.last(F.when(F.col("start"), F.col("log_message_id")), True).over(in_file))
    head = ["ts_ms", "log_level", "component"] + (["message", "request", "user_agent"] if with_text else [])
    place = F.struct("line_no", "log_message_id")
    parts = marked.groupBy("stream", "file_no", "first_id").agg(
        F.max(place).alias("__last"), *[F.min_by(c, place).alias(c) for c in head],
        *([F.transform(F.array_sort(F.collect_list(F.struct("line_no", "log_message_id", "text"))), lambda x: x["text"]).alias("__texts")] if with_text else []),
    )
    parts = cut(parts)  # read twice or more, else lines are parsed as often
    entries = parts.filter(F.col("first_id").isNotNull())
    files = parts.groupBy("stream", "file_no").agg(
        F.max_by("first_id", F.when(F.col("first_id").isNotNull(), F.col("__last"))).alias("__open"),
        F.max(F.when(F.col("first_id").isNull(), F.col("__last.log_message_id"))).alias("__carried"),
    )
    earlier = Window.partitionBy("stream").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    owed = files.withColumn("first_id", F.last("__open", True).over(earlier)).filter(
        F.col("__carried").isNotNull() & F.col("first_id").isNotNull()
    )
    if with_text:  # texts meet their entry only after the summary, so no task gets those of a whole stream
        heads = parts.filter(F.col("first_id").isNull()).select("stream", "file_no", "__texts")
        owed = owed.join(heads, ["stream", "file_no"])
    carried = owed.groupBy("stream", "first_id").agg(
        F.max_by("__carried", "file_no").alias("__carried"),
        *([F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "__texts"))), lambda x: x["__texts"])).alias("__later")] if with_text else []),
    )
    joined = entries.join(carried, ["stream", "first_id"], "left")
    if with_text:
        later = F.coalesce("__later", F.array().cast("array<string>"))
        rest = F.concat(F.slice("__texts", F.lit(2), F.size("__texts")), later)
        joined = joined.withColumns(
            {
                "text": F.array_join(F.concat("__texts", later), "\n"),
                "message": F.array_join(F.concat(F.array("message"), rest), "\n"),
            }
        )
    return joined.select(
        "stream", "first_id", F.coalesce("__carried", F.col("__last.log_message_id")).alias("last_id"), *head,
        *(["text"] if with_text else []),
    )


def embedded_entries(df: DataFrame, row_id: str, columns: list[str], year: str, layouts: Layouts) -> DataFrame:
    """Whole log lines that ended up inside other columns: row_id, and PARSED for every such line.

    Each of ``columns`` is split at line breaks and every piece is parsed on its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            ids, years = b.column(names.index(row_id)).to_pylist(), b.column(names.index(year)).to_pylist()
            out_ids, found = [], []
            for c in columns:
                for i, t, y in zip(ids, b.column(names.index(c)).to_pylist(), years):
                    for piece in (t or "").split("\n"):
                        p = layouts.parse(piece, y or 1970)
                        if p.start:
                            out_ids.append(i)
                            found.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), *_columns(found)], [row_id, *(n for n, _ in _PARSED_ARROW)])

    return df.select(row_id, *columns, year).mapInArrow(run, f"{row_id} bigint, {PARSED}")


def log_entries(messages: DataFrame, access: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """Entries of a table of log lines and the foreign lines of a table of access entries.

    ``messages``: log_message_id, stream, file_no, line_no, time, text; rows of null text are skipped.
    ``access``: entry_id, date, request, user_agent. Result: source_table, first_id, last_id, ts_ms
    (-1 without a stamp), log_level and component ('' where the layout has none), and message (with
    all later rows of the entry), request, user_agent with ``with_text``. Other columns of the inputs are ignored; empty tables
    give no rows.
    """
    rows = messages.filter(F.col("text").isNotNull())
    texts = rows.select("text")
    if access is not None:
        texts = texts.unionAll(access.select(F.explode(F.array("request", "user_agent")).alias("text")).filter("text is not null"))
    layouts = learn_layouts(texts)
    extra = [F.col("text").alias("__text")] if with_text else []
    lines = rows.select("log_message_id", "stream", "file_no", "line_no", F.year("time").alias("__year"), "text", *extra)
    parsed = parse_lines(lines, "text", "__year", layouts)
    if with_text:
        parsed = parsed.withColumnRenamed("__text", "text")
    columns = ["first_id", "last_id", "ts_ms", "log_level", "component"]
    given = columns + (["message", "request", "user_agent"] if with_text else [])
    found = assemble_entries(parsed, with_text).select(F.lit("log_messages").alias("source_table"), *given)
    if access is not None:
        inside = embedded_entries(access.withColumn("__year", F.year("date")), "entry_id", ["request", "user_agent"], "__year", layouts)
        inside = inside.select(
            F.lit("apache_log_entries").alias("source_table"), F.col("entry_id").alias("first_id"),
            F.col("entry_id").alias("last_id"), *given[2:],
        ).distinct()
        found = found.unionByName(inside)
    return found
