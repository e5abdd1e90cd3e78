"""Personal data: base patterns, and identifiers found by bootstrapped context.

Base spans are matched over whole texts: emails, IP addresses, card numbers (Luhn), phones.

Bootstrapping. Tokens that look like identifiers (``looks_like_identifier``: at least eight characters, with six digits or a mix of
letters and three digits; runs of 13 to 19 bare digits are no candidates, since the base rules refuse those that are no cards) are instances; base entities are the seeds. Each
occurrence of an instance has lexical patterns: the key it is assigned to (``password=``), the word before it (or before its key), the word
after it; whole words, however long or far. Instances assigned to a key have a fourth pattern: their format, if they are random strings
(an alphabet and a length). Distinct (pattern, instance) pairs make a graph that Spark scores in rounds:

* a pattern's confidence is the mean score of its instances, damped by its support, if at least ``SUPPORT`` of them are trusted;
* keys of secrets hardly ever hold a seed, so a key or format pattern has a confidence from its specificity, too: the damped share of its
  instances that are random strings of its most frequent format, if at least ``SUPPORT`` are. No list of names is used;
* an instance's score is the noisy-or of its patterns' confidences (a seed's is 1).

What a key or a format makes trusted lends trust to the words around it in the next round, and so on. After ``ROUNDS`` rounds, trusted
instances that are no seeds are new identifiers, and all their occurrences become spans of kind ``id``. Graph, scores and decisions are tables
of the cluster; nothing of them is collected. Confident patterns are broadcast to the graph after a count, so a pattern of very many instances
is not gathered.

Edge cases: null and empty texts have no spans; very long texts are read whole (all matchers
are linear); repeated rows get their spans each, and count once in the graph; rows with null ids get
spans like any other; spans of equal place keep the order of their kinds; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table, unused

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
SUPPORT = 4
CONFIDENT = 0.6
DAMPING = 2.0
#: What makes a string random: its length and distinct characters.
RANDOM_LENGTH = 16
RANDOM_CHARACTERS = 10

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![^\s\"'`<>()\[\]{}|,;])[^\s\"'`<>()\[\]{}|,;]*[0-9][^\s\"'`<>()\[\]{}|,;]*")
#: Words of patterns, and what may stand between a key and its value.
_WORD = re.compile(r"[^\s\"'`<>()\[\]{}|,;=:]+")
_ASSIGNED = re.compile(r"[ \t\"'`)\]}]*([=:]+)[ \t\"'`(\[{]*")
#: Longer words stand in patterns by their digest.
LONG_WORD = 64

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in the order of kinds and places."""
    t = text or ""
    out: list[Span] = []
    at = t.find("@")
    end = 0
    while at >= 0:
        first = at
        while first > end and t[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(t, at) if first < at else None
        if m:
            out.append(("email", first, m.end()))
            end = m.end()
        at = t.find("@", max(at + 1, end))
    if _DIGIT.search(t):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(t):
            if m.end() - m.start() <= 40:  # 19 digits with a separator each are shorter
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in t:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


def looks_like_identifier(token: str) -> bool:
    digits = sum("0" <= c <= "9" for c in token)
    if 13 <= digits <= 19 and not any(c.isalpha() for c in token):
        return False
    return len(token) >= 8 and (digits >= 6 or (digits >= 3 and any(c.isalpha() for c in token)))


def occurrences(text: str | None, spans: list[Span]) -> list[tuple[str, bool, int, int, list[str]]]:
    """(instance, is seed, start, end, patterns) of seeds and candidates in a text."""
    t = text or ""
    found = [(t[a:b], True, a, b) for _, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    k = 0
    for m in _TOKEN.finditer(t) if _DIGIT.search(t) else ():
        a, b = m.span()
        cut = max(t.rfind("=", a, b), t.rfind(":", a, b)) + 1
        a = cut or a
        while b > a and t[b - 1] in ".!?":
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and looks_like_identifier(t[a:b]):
            found.append((t[a:b], False, a, b))
    if not found:
        return []
    # Words are cut at the neighbouring spans, so that all slices together are no longer than the text.
    found.sort(key=lambda f: (f[2], f[3]))
    words = [m.span() for m in _WORD.finditer(t)]
    starts = [s for s, _ in words]

    def before(at: int, least: int) -> tuple[int, int] | None:
        k = bisect_left(starts, at) - 1
        s, e = (max(words[k][0], least), min(words[k][1], at)) if k >= 0 else (0, 0)
        return (s, e) if s < e else None

    out, end = [], 0
    for k, (value, seed, a, b) in enumerate(found):
        patterns = []
        left = before(a, end)
        assigned = left and _ASSIGNED.fullmatch(t, left[1], a)
        if left and assigned:
            patterns.append(f"K {_named(t[slice(*left)])}{assigned[1]}")
            left = before(left[0], end)
        if left:
            patterns.append(f"L {_named(t[slice(*left)])}")
        nxt = bisect_left(starts, b)
        if nxt and words[nxt - 1][1] > b:
            nxt -= 1
        if nxt < len(words):
            s, e = max(words[nxt][0], b), min(words[nxt][1], found[k + 1][2] if k + 1 < len(found) else len(t))
            if s < e:
                patterns.append(f"R {_named(t[s:e])}")
        end = max(end, b)
        out.append((value, seed, a, b, patterns))
    return out


def _named(word: str) -> str:
    word = word.lower()
    return word if len(word) <= LONG_WORD else hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


_FOUND = (
    "base array<struct<kind string, first long, last long>>, "
    "seen array<struct<instance string, seed boolean, first long, last long, patterns array<string>>>"
)


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        base, seen = [], []
        for t in df["text"]:
            spans = base_spans(t)
            base.append([{"kind": k, "first": a, "last": b} for k, a, b in spans])
            seen.append([{"instance": v, "seed": s, "first": a, "last": b, "patterns": p} for v, s, a, b, p in occurrences(t, spans)])
        yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "digest": df["digest"], "base": base, "seen": seen})


def format_of(value):
    """Alphabet and length of a random string: ``x40`` is 40 lower-case hexadecimal digits. Null for others."""
    alphabet = F.when(value.rlike("^[0-9a-f]+$"), "x").when(value.rlike("^[0-9A-F]+$"), "X").when(value.rlike("^[0-9A-Za-z+/=_-]+$"), "w")
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= RANDOM_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= RANDOM_CHARACTERS)
    return F.when(random, F.concat(alphabet, F.length(value).cast("string")))


def with_formats(pairs: DataFrame) -> DataFrame:
    """(pattern, instance, seed, format): the edges, and one from its format to each random instance that is assigned to a key."""
    known = pairs.select("pattern", "instance", "seed", F.when(F.col("pattern").startswith("K "), format_of(F.col("instance"))).alias("format"))
    shaped = known.where("format IS NOT NULL AND NOT seed").select("instance", "format").distinct()
    return known.unionByName(shaped.select(F.concat(F.lit("F "), "format").alias("pattern"), "instance", F.lit(False).alias("seed"), "format"))


def specificity(edges: DataFrame) -> DataFrame:
    """(pattern, own): the damped share of a key's or format's instances that are random strings of one format."""
    each = edges.where(F.col("pattern").rlike("^[KF] ")).groupBy("pattern", "format").agg(F.count("*").alias("n"))
    most = F.max(F.when(F.col("format").isNotNull(), F.col("n")))
    whole = each.groupBy("pattern").agg(F.sum("n").alias("n"), most.alias("most"))
    return whole.where(F.col("most") >= SUPPORT).select("pattern", (F.col("most") / (F.col("n") + F.lit(DAMPING))).alias("own"))


def bootstrap(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """New identifiers: (instance,) from distinct (pattern, instance, seed) edges."""
    edges = materialize(with_formats(pairs))
    own = materialize(specificity(edges).where(F.col("own") >= CONFIDENT))
    score = edges.select("instance", F.col("seed").cast("double").alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        known = edges.join(score, "instance")
        rule = known.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("score").alias("mass"), F.sum((F.col("score") >= CONFIDENT).cast("int")).alias("support"))
        mean = F.when(F.col("support") >= SUPPORT, F.col("mass") / (F.col("n") + F.lit(DAMPING)))
        rule = rule.join(own, "pattern", "left").select("pattern", F.greatest(mean, "own").alias("conf")).where(F.col("conf") >= CONFIDENT)
        rule = broadcast_if_small(materialize(rule))
        doubt = F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999))))
        hit = edges.join(rule, "pattern").groupBy("instance").agg((F.lit(1.0) - F.exp(doubt)).alias("hit"))
        score = materialize(score.join(hit, "instance", "left").select("instance", F.greatest("score", F.coalesce("hit", F.lit(0.0))).alias("score")))
    seeds = edges.where("seed").select("instance").distinct()
    return score.where(F.col("score") >= CONFIDENT).select("instance").join(seeds, "instance", "left_anti")


_SPANS = "array<struct<kind:string,first:bigint,last:bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, base, spans): base spans and all spans as structs (kind, first, last).

    ``digest`` is the MD5 of the text, to tell rows of one doc_id apart.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    found = materialize(keyed.mapInPandas(_find, "doc_id long, digest string, " + _FOUND).withColumn("row", F.monotonically_increasing_id()))
    seen = found.select("row", F.explode("seen").alias("o")).select("row", "o.*")
    pairs = seen.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    fresh = bootstrap(pairs)
    span = F.struct(F.lit("id").alias("kind"), "first", "last")
    more = seen.where(~F.col("seed")).join(fresh, "instance").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("more"))
    out = found.select("row", "doc_id", "digest", "base").join(more, "row", "left")
    return out.select("doc_id", "digest", "base", F.concat(F.col("base").cast(_SPANS), F.coalesce(F.col("more").cast(_SPANS), F.array().cast(_SPANS))).alias("spans"))


def _joined(spans):
    text = lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def replace_spans(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become the first one's."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, more in batches:
        yield pd.Series(
            [t if t is None else replace_spans(t, base_spans(t) + [("id", *map(int, s.split(":"))) for s in (m or "").split(",") if s]) for t, m in zip(texts, more, strict=True)],
            dtype=object,
        )


def redact(docs: DataFrame) -> DataFrame:
    """docs' columns with every span of a text replaced by its kind in angle brackets.

    A column n_chars, if there is one, is counted again. Only the places of discovered identifiers
    are joined back, on doc_id and digest; base spans are matched again.
    """
    ids = F.filter("spans", lambda s: s["kind"] == "id")
    places = F.array_join(F.transform(ids, lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))), ",")
    key, digest, more = (unused(n, docs.columns) for n in ("key", "digest", "more"))
    found = find(docs.select("doc_id", "text")).where(F.size(ids) > 0)
    found = found.select(F.coalesce("doc_id", F.lit(-1)).alias(key), F.col("digest").alias(digest), places.alias(more)).dropDuplicates([key, digest])
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    both = rows.join(broadcast_if_small(materialize(found)), [key, digest], "left").withColumn("text", F.pandas_udf(_redact, "string")("text", more))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)


def query(spark, sf_dir):
    out = find(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
