"""JSON queries over logs, compiled to one Column.

A body of the search language is parsed with ``json.loads`` and turned, recursively, into a boolean
expression over doc_id, ts, fields and text; Catalyst does the rest. What is unknown counts as no match:
filters drop it by themselves, so leaves stay plain and can be pushed into scans, and negations say so.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.analysis import query_tokens, tokens


class QueryError(ValueError):
    """A query that cannot be read."""


class UnsupportedQuery(QueryError):
    """A query that is known but has no executor here."""


#: names of the whole text in queries
TEXT_FIELDS = ("text", "_all", "message")
UNSUPPORTED = (
    "script", "geo_shape", "xy_point", "distance_feature", "percolate", "rank_feature", "script_score", "neural",
    "neural_sparse", "span_containing", "span_within", "field_masking_span", "span_multi", "function_score", "hybrid",
)


def _not(c: Column) -> Column:
    """Whether a document does not match; what is unknown does not."""
    return ~F.coalesce(c, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _single(body: Any) -> tuple[str, Any]:
    if not isinstance(body, dict) or len(body) != 1:
        raise QueryError(f"expected one field: {body!r}")
    return next(iter(body.items()))


def wildcard_regex(pattern: str) -> str:
    """``*`` any run, ``?`` any character, a backslash takes the next character as it is."""
    out, escaped = [], False
    for c in pattern:
        if escaped:
            out.append(re.escape(c))
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
    return "".join(out)


@dataclass
class Compiler:
    """Compiles queries for one kind of document.

    ``columns`` maps field names to real columns (hot fields); other names are looked up in the map
    ``fields``. With ``strict``, should clauses are optional beside must or filter clauses, else the
    documents of must and should are united. ``terms`` names a stored array of terms, and ``day`` a column
    with the day of ts that the data are partitioned by, if there are such.
    """

    columns: dict[str, Column] = field(default_factory=dict)
    strict: bool = False
    terms: str | None = None
    day: str | None = None

    def value(self, name: str) -> Column:
        """A field as text."""
        if name in TEXT_FIELDS:
            return F.col("text")
        return self.columns[name].cast("string") if name in self.columns else F.col("fields")[name]

    def _tokens(self, name: str, lower: bool) -> Column:
        return tokens(self.value(name), lower or name in TEXT_FIELDS)

    def has_token(self, name: str, token: str, lower: bool = False) -> Column:
        """Whether a field has a term. A substring test in front spares most rows the tokeniser."""
        lower = lower or name in TEXT_FIELDS
        token = token.lower() if lower else token
        if self.terms and (name in TEXT_FIELDS or not lower):
            return F.array_contains(self.terms, token if name in TEXT_FIELDS else f"{name}~{token}")
        value = F.lower(self.value(name)) if lower else self.value(name)
        return value.contains(token) & F.array_contains(self._tokens(name, lower), token)

    def required(self, query: dict | None) -> list[str]:
        """Stored terms that every hit of a query must have; none where that can't be told."""
        if not query or not self.terms:
            return []
        kind, body = _single(query)
        if kind == "term":
            name, spec = _single(body)
            spec = spec if isinstance(spec, dict) else {"value": spec}
            if name not in TEXT_FIELDS and not spec.get("case_insensitive", False):
                return [f"{name}~{t}" for t in query_tokens(str(spec["value"]))]
            return query_tokens(str(spec["value"]), True) if name in TEXT_FIELDS else []
        if kind == "match":
            name, spec = _single(body)
            spec = spec if isinstance(spec, dict) else {"query": spec}
            found = query_tokens(str(spec["query"]), True)
            every = str(spec.get("operator", "OR")).upper() == "AND" or len(found) == 1
            return found if every and name in TEXT_FIELDS else []
        if kind == "constant_score":
            return self.required(body["filter"])
        if kind == "bool" and (self.strict or "should" not in body):
            parts = [x for k in ("must", "filter") for x in (body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]])]
            return sorted({t for q in parts for t in self.required(q)})
        return []

    def compile(self, query: dict) -> Column:
        kind, body = _single(query)
        if kind in UNSUPPORTED:
            raise UnsupportedQuery(f"{kind} queries are not supported")
        method: Callable[[Any], Column] | None = getattr(self, f"_q_{kind}", None)
        if method is None:
            raise QueryError(f"no such query: {kind}")
        return method(body)

    # terms

    def _q_term(self, body: dict) -> Column:
        name, spec = _single(body)
        spec = spec if isinstance(spec, dict) else {"value": spec}
        lower = bool(spec.get("case_insensitive", False))
        return _all([self.has_token(name, t, lower) for t in query_tokens(str(spec["value"]), lower)])

    def _q_terms(self, body: dict) -> Column:
        name, values = _single({k: v for k, v in body.items() if k != "boost"})
        return _any([self.has_token(name, t) for v in values for t in query_tokens(str(v))])

    def _q_terms_set(self, body: dict) -> Column:
        name, spec = _single(body)
        found = sum((F.when(self._contains_all(name, str(v)), 1).otherwise(0) for v in spec["terms"]), F.lit(0))
        if "minimum_should_match_field" in spec:
            least = self.value(spec["minimum_should_match_field"]).try_cast("int")
        else:
            least = F.lit(int(spec.get("minimum_should_match", 1)))
        return found >= least

    def _contains_all(self, name: str, text: str) -> Column:
        return _all([self.has_token(name, t) for t in query_tokens(text)])

    def _q_fuzzy(self, body: dict) -> Column:
        name, spec = _single(body)
        spec = spec if isinstance(spec, dict) else {"value": spec}
        value, prefix = str(spec["value"]), int(spec.get("prefix_length", 0))
        most = spec.get("fuzziness", "AUTO")
        if isinstance(most, str) and most.upper().startswith("AUTO"):
            most = 0 if len(value) < 3 else 1 if len(value) < 6 else 2
        near = lambda t: (F.levenshtein(t, F.lit(value), int(most)) >= 0) & t.startswith(value[:prefix])
        return F.exists(self._tokens(name, False), near)

    # full text

    def _q_match(self, body: dict) -> Column:
        name, spec = _single(body)
        spec = spec if isinstance(spec, dict) else {"query": spec}
        lower = bool(spec.get("case_insensitive", True))
        parts = [self.has_token(name, t, lower) for t in query_tokens(str(spec["query"]), lower)]
        return _all(parts) if str(spec.get("operator", "OR")).upper() == "AND" else _any(parts)

    def _q_match_phrase(self, body: dict) -> Column:
        name, spec = _single(body)
        phrase = str(spec["query"] if isinstance(spec, dict) else spec)
        return self.value(name).contains(phrase) & self._contains_all(name, phrase)

    def _q_match_phrase_prefix(self, body: dict) -> Column:
        name, spec = _single(body)
        phrase = str(spec["query"] if isinstance(spec, dict) else spec)
        value = self.value(name)
        return value.startswith(phrase) if len(query_tokens(phrase)) <= 1 else value.contains(phrase)

    def _q_match_bool_prefix(self, body: dict) -> Column:
        name, spec = _single(body)
        found = query_tokens(str(spec["query"] if isinstance(spec, dict) else spec), True)
        if not found:
            return F.lit(False)
        last = F.exists(self._tokens(name, True), lambda t: t.startswith(found[-1]))
        return _any([*(self.has_token(name, t, True) for t in found[:-1]), last])

    def _q_multi_match(self, body: dict) -> Column:
        return _any([self.value(f).contains(str(body["query"])) for f in body["fields"]])

    def _q_more_like_this(self, body: dict) -> Column:
        like = body["like"] if isinstance(body["like"], list) else [body["like"]]
        found = sorted({t for x in like for t in query_tokens(str(x), True)})  # all of them, unless a number is asked for
        found = found[: int(body["max_query_terms"])] if "max_query_terms" in body else found
        least = str(body.get("minimum_should_match", "30%"))
        need = math.ceil(len(found) * float(least[:-1]) / 100) if least.endswith("%") else int(least)
        parts = [
            F.size(F.array_intersect(self._tokens(f, True), F.array(*[F.lit(t) for t in found]))) >= max(1, need)
            for f in body.get("fields", ["text"])
        ]
        return _any(parts) if found else F.lit(False)

    # parts of values

    def _q_prefix(self, body: dict) -> Column:
        name, spec = _single(body)
        spec = spec if isinstance(spec, dict) else {"value": spec}
        start, value = str(spec["value"]), self.value(name)
        if spec.get("case_insensitive", False):
            start, value = start.lower(), F.lower(value)
        return value.startswith(start)

    def _by_regex(self, name: str, pattern: str, spec: dict) -> Column:
        flags = "(?i)" if spec.get("case_insensitive", False) else ""
        if spec.get("whole_value", False):
            return self.value(name).rlike(f"{flags}(?:{pattern})")
        head = "" if name in TEXT_FIELDS else "^"  # field terms carry their name in front
        return F.exists(self._tokens(name, False), lambda t: t.rlike(f"{flags}{head}(?:{pattern})"))

    def _q_regexp(self, body: dict) -> Column:
        name, spec = _single(body)
        spec = spec if isinstance(spec, dict) else {"value": spec}
        return self._by_regex(name, str(spec["value"]), spec)

    def _q_wildcard(self, body: dict) -> Column:
        name, spec = _single(body)
        spec = spec if isinstance(spec, dict) else {"value": spec}
        pattern = str(spec.get("value", spec.get("wildcard", "")))
        return self._by_regex(name, wildcard_regex(pattern), spec)

    # other values

    def _q_range(self, body: dict) -> Column:
        name, spec = _single(body)
        if name in ("ts", "timestamp", "date", "time"):
            value, wrap = F.col("ts"), lambda v: F.lit(v).cast("timestamp")
        else:
            value, wrap = (F.col("doc_id") if name in ("doc_id", "_id") else self.value(name).try_cast("double")), F.lit
        tests = {"gte": value.__ge__, "gt": value.__gt__, "lte": value.__le__, "lt": value.__lt__}
        parts = [tests[op](wrap(v)) for op, v in spec.items() if op in tests]
        if self.day and value is not None and name in ("ts", "timestamp", "date", "time"):
            days = {"g": F.col(self.day).__ge__, "l": F.col(self.day).__le__}
            parts += [days[op[0]](F.to_date(wrap(v))) for op, v in spec.items() if op in tests]
        if not parts:
            raise QueryError("a range without bounds")
        return _all(parts)

    def _q_exists(self, body: dict) -> Column:
        return self.value(body["field"]).isNotNull()

    def _q_ids(self, body: dict) -> Column:
        return F.col("doc_id").isin([int(v) for v in body["values"]])

    def _point(self, name: str) -> tuple[Column, Column]:
        parts = F.split(self.value(name), ",")
        return F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")

    def _q_geo_distance(self, body: dict) -> Column:
        name, at = _single({k: v for k, v in body.items() if k not in ("distance", "distance_type", "validation_method")})
        m = re.fullmatch(r"\s*([\d.]+)\s*(mm|cm|m|km|mi|yd|ft|nmi)?\s*", str(body["distance"]))
        if not m:
            raise QueryError(f"no distance: {body['distance']}")
        metres = float(m[1]) * {"mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1e3, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "nmi": 1852.0}[m[2] or "m"]
        lat, lon = self._point(name)
        half = lambda c, x: F.pow(F.sin(F.radians(c - F.lit(float(x))) / 2), 2)
        a = half(lat, at["lat"]) + F.cos(F.radians(lat)) * math.cos(math.radians(float(at["lat"]))) * half(lon, at["lon"])
        return 2 * 6371008.8 * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) <= metres

    def _q_geo_bounding_box(self, body: dict) -> Column:
        name, box = _single(body)
        lat, lon = self._point(name)
        a, b = box["top_left"], box["bottom_right"]
        return lat.between(float(b["lat"]), float(a["lat"])) & lon.between(float(a["lon"]), float(b["lon"]))

    # positions

    def _near(self, name: str, words: list[str], gaps: int, ordered: bool) -> Column:
        """Whether the words stand in the field with at most ``gaps`` other terms among them."""
        found = self._tokens(name, True)
        words = [w.lower() for w in words]
        if not words:
            return F.lit(False)
        every = _all([self.has_token(name, w, True) for w in sorted(set(words))])  # spares most rows the walk
        return every & (self._in_order(found, words, gaps) if ordered else self._gathered(found, words, gaps))

    @staticmethod
    def _in_order(found: Column, words: list[str], gaps: int) -> Column:
        """Whether the words come in this order with at most ``gaps`` other terms among them.

        One walk over the terms, which keeps for every word the latest place at which a chain up to it began.
        """
        n = len(words)
        start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("met"), *[F.lit(-1).alias(f"s{k}") for k in range(n)])

        def step(s: Column, t: Column) -> Column:
            before = [s["i"], *[s[f"s{k}"] for k in range(n - 1)]]
            chains = [F.when(t == w, before[k]).otherwise(s[f"s{k}"]).alias(f"s{k}") for k, w in enumerate(words)]
            closes = (t == words[-1]) & (before[-1] >= 0) & (s["i"] - before[-1] + 1 - n <= gaps)
            return F.struct((s["i"] + 1).alias("i"), (s["met"] | closes).alias("met"), *chains)

        return F.aggregate(found, start, step, lambda s: s["met"])

    @staticmethod
    def _gathered(found: Column, words: list[str], gaps: int) -> Column:
        """Whether some run of terms holds all words, each as often as it is asked for, and at most ``gaps`` others.

        One walk over the terms, which keeps the last places of every word: a run that ends here is shortest from
        the earliest of them on.
        """
        need = sorted({w: words.count(w) for w in words}.items())
        places = F.struct(*[F.array_repeat(F.lit(-1), n).alias(f"w{k}") for k, (_, n) in enumerate(need)])
        start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("met"), places.alias("at"))

        def step(s: Column, t: Column) -> Column:
            at = [F.when(t == w, F.concat(F.slice(s["at"][f"w{k}"], 2, n - 1) if n > 1 else F.array().cast("array<int>"), F.array(s["i"]))).otherwise(s["at"][f"w{k}"]) for k, (w, n) in enumerate(need)]
            return F.struct((s["i"] + 1).alias("i"), s["met"].alias("met"), F.struct(*[a.alias(f"w{k}") for k, a in enumerate(at)]).alias("at"))

        def close(s: Column) -> Column:
            first = [s["at"][f"w{k}"][0] for k in range(len(need))]
            low = F.least(*first) if len(first) > 1 else first[0]
            return F.struct(s["i"].alias("i"), (s["met"] | ((low >= 0) & (s["i"] - low - len(words) <= gaps))).alias("met"), s["at"].alias("at"))

        # terms of other words cannot end a shortest run, but the test is cheap
        return F.aggregate(found, start, lambda s, t: close(step(s, t)), lambda s: s["met"])

    def _q_intervals(self, body: dict) -> Column:
        name, spec = _single(body)
        rule, inner = _single(spec)
        if rule == "match":
            gaps = int(inner.get("max_gaps", -1))
            return self._near(name, query_tokens(inner["query"], True), gaps if gaps >= 0 else 10**6, bool(inner.get("ordered", False)))
        if rule in ("any_of", "all_of"):
            parts = [self._q_intervals({name: x}) for x in inner["intervals"]]
            return _any(parts) if rule == "any_of" else _all(parts)
        raise UnsupportedQuery(f"intervals by {rule}")

    def _q_span_term(self, body: dict) -> Column:
        name, spec = _single(body)
        return self.has_token(name, str(spec["value"] if isinstance(spec, dict) else spec), True)

    def _span_words(self, clauses: list[dict]) -> tuple[str, list[str]]:
        names, words = set(), []
        for c in clauses:
            if set(c) != {"span_term"}:
                raise UnsupportedQuery("spans of other things than terms")
            name, spec = _single(c["span_term"])
            names.add(name)
            words.append(str(spec["value"] if isinstance(spec, dict) else spec))
        if len(names) != 1:
            raise QueryError("spans need one field")
        return names.pop(), words

    def _q_span_near(self, body: dict) -> Column:
        name, words = self._span_words(body["clauses"])
        return self._near(name, words, int(body.get("slop", 0)), bool(body.get("in_order", True)))

    def _q_span_or(self, body: dict) -> Column:
        return _any([self.compile(c) for c in body["clauses"]])

    def _q_span_not(self, body: dict) -> Column:
        return self.compile(body["include"]) & _not(self.compile(body["exclude"]))

    def _q_span_first(self, body: dict) -> Column:
        name, words = self._span_words([body["match"]])
        at = F.array_position(self._tokens(name, True), words[0].lower())
        return (at > 0) & (at <= int(body["end"]))

    # combinations

    def _clauses(self, body: dict, kind: str) -> list[Column]:
        found = body.get(kind, [])
        return [self.compile(q) for q in (found if isinstance(found, list) else [found])]

    def _q_bool(self, body: dict) -> Column:
        must = [*self._clauses(body, "must"), *self._clauses(body, "filter")]
        should, must_not = self._clauses(body, "should"), self._clauses(body, "must_not")
        least = int(body.get("minimum_should_match", 1))
        some = _any(should)
        if should and least > 1:
            some = sum((F.when(s, 1).otherwise(0) for s in should), F.lit(0)) >= least
        if must and should:
            wanted = _all(must) & (some if "minimum_should_match" in body else F.lit(True)) if self.strict else _all(must) | some
        else:
            wanted = _all(must) if must else some
        return wanted & _not(_any(must_not)) if must_not else wanted

    def _q_boosting(self, body: dict) -> Column:
        return self.compile(body["positive"])

    def _q_constant_score(self, body: dict) -> Column:
        return self.compile(body["filter"])

    def _q_dis_max(self, body: dict) -> Column:
        return _any([self.compile(q) for q in body["queries"]])

    def _q_wrapper(self, body: dict) -> Column:
        return self.compile(json.loads(base64.b64decode(body["query"])))

    def _q_query_string(self, body: dict) -> Column:
        return _QueryString(self, body).parse()

    def _q_simple_query_string(self, body: dict) -> Column:
        return _QueryString(self, body).parse()

    _q_query_string_ = _q_query_string
    _q_simple_query_string_ = _q_simple_query_string


class _QueryString:
    """``field:word "a phrase" AND (this OR -that*)``; words beside each other are joined by the default operator."""

    _LEX = re.compile(r'\s*(\(|\)|&&|\|\||[|+!]|-(?=\S)|"(?:[^"\\]|\\.)*"|(?:[^\s()"|:]|\\.)+:(?=\S)|(?:[^\s()"|]|\\.)+)')

    def __init__(self, compiler: Compiler, body: dict) -> None:
        self.compiler = compiler
        fields = body.get("fields") or [body.get("default_field", "text")]
        self.fields = ["text" if f == "*" else f for f in fields]
        self.both = str(body.get("default_operator", "OR")).upper() == "AND"
        self.words = self._LEX.findall(str(body["query"]))
        self.at = 0

    def _peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def _next(self) -> str:
        self.at += 1
        return self.words[self.at - 1]

    def parse(self) -> Column:
        if not self.words:
            return F.lit(False)
        out = self._either()
        if self._peek():
            raise QueryError(f"unexpected {self._peek()!r}")
        return out

    def _either(self) -> Column:
        parts = [self._both()]
        while self._peek():
            if self._peek() in ("OR", "||", "|"):
                self._next()
                parts.append(self._both())
            elif self._peek() == ")" or self.both:
                break
            else:
                parts.append(self._both())
        return _any(parts)

    def _both(self) -> Column:
        out = self._one()
        while self._peek() in ("AND", "&&", "+") or (self.both and self._peek() not in ("", ")", "OR", "||", "|")):
            if self._peek() in ("AND", "&&", "+"):
                self._next()
            out = out & self._one()
        return out

    def _one(self, names: list[str] | None = None) -> Column:
        if not self._peek():
            raise QueryError("a query string that ends too early")
        word = self._next()
        names = names or self.fields
        if word in ("NOT", "-", "!"):
            return _not(self._one(names))
        if word == "+":
            return self._one(names)
        if word == "(":
            before, self.fields = self.fields, names
            out = self._either()
            self.fields = before
            if self._peek() != ")":
                raise QueryError("a parenthesis is missing")
            self._next()
            return out
        if word.endswith(":") and len(word) > 1 and self._peek():
            return self._one([word[:-1]])
        if word.startswith('"'):
            return _any([self.compiler._q_match_phrase({n: word[1:-1]}) for n in names])
        if "*" in word or "?" in word:
            return _any([self.compiler._q_wildcard({n: {"value": word, "case_insensitive": True}}) for n in names])
        return _any([self.compiler._q_match({n: {"query": word, "operator": "AND"}}) for n in names])


@dataclass
class Search:
    """A body of the search language, in parts."""

    query: dict | None
    sort: list
    size: int | None
    offset: int
    aggs: dict
    post_filter: dict | None
    highlight: dict | None
    timeout_s: float | None


def parse_body(body: str | dict) -> Search:
    """Reads a body; text after it is an error."""
    try:
        found = json.loads(body) if isinstance(body, str) else body
    except ValueError as e:
        raise QueryError(f"no JSON: {e}") from e
    if not isinstance(found, dict):
        raise QueryError("a body is an object")
    if "suggest" in found or "script_fields" in found:
        raise UnsupportedQuery("suggest and script_fields are not supported")
    limit = found.get("timeout")
    unit = re.fullmatch(r"(\d+)(ms|s|m|h)", str(limit)) if limit else None
    seconds = float(unit[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[unit[2]] if unit else None
    return Search(
        found.get("query"), found.get("sort", []), found.get("size"), int(found.get("from", 0)), found.get("aggs", found.get("aggregations", {})),
        found.get("post_filter"), found.get("highlight"), seconds,
    )


def sorting(compiler: Compiler, spec: list) -> list[Column]:
    """Order of hits: newest first where nothing is named; doc_id breaks ties."""
    out = []
    for s in spec if isinstance(spec, list) else [spec]:
        name, how = _single(s) if isinstance(s, dict) else (s, "asc")
        order = how.get("order", "asc") if isinstance(how, dict) else how
        c = F.col("ts") if name in ("ts", "timestamp", "date") else F.col("doc_id") if name in ("doc_id", "_id") else compiler.value(name)
        if isinstance(how, dict) and how.get("type") == "number":
            c = c.try_cast("double")
        out.append(c.desc_nulls_last() if str(order).lower() == "desc" else c.asc_nulls_last())
    return [*(out or [F.col("ts").desc_nulls_last()]), F.col("doc_id").asc()]


def highlighted(text: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with every one of the words marked, in any case."""
    if not words:
        return text
    either = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({either})(?![\p{{L}}\p{{N}}_])", f"{before}$1{after}")


#: members of queries that say how to match, not what
_SETTINGS = ("operator", "default_operator", "default_field", "field", "fields", "minimum_should_match", "minimum_should_match_field", "fuzziness", "distance", "must_not", "exclude")


def _query_words(query: Any) -> list[str]:
    if isinstance(query, dict):
        return [w for k, v in query.items() if k not in _SETTINGS for w in _query_words(v)]
    if isinstance(query, list):
        return [w for v in query for w in _query_words(v)]
    return query_tokens(query, True) if isinstance(query, str) else []


def search(logs: DataFrame, body: str | dict, compiler: Compiler | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Hits of a body, in order: all columns of ``logs``, and ``highlight`` where asked for.

    ``start`` and ``end`` bound ts, both included. ``size`` and ``from`` are applied last.
    """
    compiler, parsed = compiler or Compiler(), parse_body(body)
    if start is not None:
        logs = logs.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        logs = logs.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    hits = logs.filter(compiler.compile(parsed.query)) if parsed.query else logs
    if parsed.post_filter:
        hits = hits.filter(compiler.compile(parsed.post_filter))
    if parsed.highlight is not None:
        hits = hits.withColumn("highlight", highlighted(F.col("text"), _query_words(parsed.query)))
    hits = hits.orderBy(*sorting(compiler, parsed.sort))
    if parsed.offset:
        hits = hits.offset(parsed.offset)
    return hits.limit(int(parsed.size)) if parsed.size is not None else hits


def url_query(text: str) -> dict:
    """The body of a plain query text: every word must be in the text."""
    if not text.strip():
        raise QueryError("no query")
    return {"query": {"match": {"_all": {"query": text, "operator": "AND"}}}}
