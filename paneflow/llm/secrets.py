"""Secret scans with multipart credential linking (operator 8), DataFrame functions only.

Base kinds are found by their patterns alone. Weak kinds - account identifiers,
opaque tokens and endpoints - say little by themselves: they are reported only
where the complementary parts stand within SCOPE code points of each other:

* ``ident`` beside a secret (assign, hex, token) in the scope,
* ``token`` beside an identifier (access, ident) in the scope,
* ``endpoint`` beside both an identifier and a secret in the scope.

The parts are interval-joined: spans are dealt by row and by every bucket that they
touch, the completing parts with their scope, so the join is an equi-join and a row
with many parts never forms all pairs beyond a scope. A pair meets in the first
bucket that both stand in.

Positions are code points, ends exclusive. A pattern's matches are leftmost and
do not overlap within their kind. Null texts count as empty; repeated rows each
get the same answer; an empty table gives nothing. Very long texts are scanned whole,
in time that grows with their length and little more with their matches. Spans that
start together are listed by kind. Only the id and the text are read, so the names of
other columns clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace

SCOPE = 200
# The base patterns, with the least lengths of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# The weak patterns of the method.
IDENT = r"""(?i:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{20,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
PATTERNS = (ASSIGN, ACCESS, HEX, IDENT, TOKEN, ENDPOINT)
#: Matches whose places are summed at a time.
BLOCK = 256
#: All kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
BASE = KINDS[:3]
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(lengths: Column, kind: int) -> Column:
    """Spans from (between, found) lengths: their running sums, first inside blocks of BLOCK matches, then over the blocks.

    An array that grows by one element is copied each time; so neither kind of array is long.
    """
    one = F.struct(F.array().cast(_SPAN).alias("out"), F.lit(0).alias("at"))
    all_ = F.struct(F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit(0).alias("at"))

    def step(held: Column, pair: Column) -> Column:
        begin = held["at"] + pair["between"]
        end = begin + pair["found"]
        return F.struct(F.array_append(held["out"], F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("out"), end.alias("at"))

    def join(held: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + held["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + held["at"]).alias("end")))
        return F.struct(F.array_append(held["out"], moved).alias("out"), (held["at"] + block["at"]).alias("at"))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(lengths, i, BLOCK), one, step))
    return F.flatten(F.aggregate(blocks, all_, join, lambda held: held["out"]))


def spans(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end) of the matches ``found`` of a pattern: the text between matches gives their places."""
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("between"), found.alias("found"))
    lengths = F.transform(pairs, lambda p: F.struct(F.length(p["between"]).alias("between"), F.length(p["found"]).alias("found")))
    return F.when(F.size(found) > 0, _running(lengths, kind)).otherwise(F.array().cast(_SPAN))


def _long_enough(every: Column, found: Column) -> Column:
    """Spans of ASSIGN whose value has ASSIGN_LEAST characters; the short ones have taken their place."""
    value = lambda x: F.regexp_extract(x["found"], ASSIGN, 1)
    return F.transform(F.filter(F.arrays_zip(every.alias("span"), found.alias("found")), lambda x: F.length(value(x)) >= ASSIGN_LEAST), lambda x: x["span"])


def _listed(found: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(found: DataFrame) -> DataFrame:
    """(doc_id, mark, weak): the weak spans with their complementary parts in scope."""
    each = found.select("doc_id", "mark", F.explode(F.concat("base", "weak")).alias("span")).distinct()
    each = each.select("doc_id", "mark", "span", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("span.kind") + 1).alias("kind"))
    low, high = F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)
    # what a span is, and which of them it may complete
    parts = each.withColumn("part", F.when(F.col("kind").isin("access", "ident"), "identifier").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret"))
    weak = parts.where(F.col("kind").isin(*KINDS[3:])).withColumn("low", low).withColumn("bucket", F.explode(F.sequence("low", high)))
    # a long span reaches over buckets: it stands in each that it or its scope touches
    reach = F.sequence(low - 1, high + 1)
    near = parts.where("part <> 'endpoint'").select("doc_id", "mark", F.col("part").alias("part2"), F.col("start").alias("start2"), F.col("end").alias("end2"), (low - 1).alias("low2"), F.explode(reach).alias("bucket"))
    same = weak["doc_id"].eqNullSafe(near["doc_id"]) & (weak["mark"] == near["mark"]) & (weak["bucket"] == near["bucket"]) & (weak["bucket"] == F.greatest("low", "low2"))
    gap = F.greatest(F.col("start") - F.col("end2"), F.col("start2") - F.col("end"))
    met = weak.join(near, same & (gap <= SCOPE) & (F.col("part") != F.col("part2"))).select(weak["doc_id"], weak["mark"], "span", "kind", "part2")
    whole = met.groupBy("doc_id", "mark", "span", "kind").agg(F.count_distinct("part2").alias("parts"))
    whole = whole.where((F.col("kind") != "endpoint") | (F.col("parts") == 2))
    return whole.groupBy("doc_id", "mark").agg(F.collect_list("span").alias("linked"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and linked, arrays of (start, kind, end); a kind is a place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    # a pattern's matches are a column of their own, so that each passes over the text once for them, and once more for what is between if there are any
    matched = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(PATTERNS)))
    every = matched.select("*", *(spans(F.col("text"), F.col(f"m{k}"), p, k).alias(f"s{k}") for k, p in enumerate(PATTERNS)))
    base = F.concat(_long_enough(F.col("s0"), F.col("m0")), "s1", "s2")
    found = Workspace(docs.sparkSession, "secrets").table(every.select("doc_id", "mark", base.alias("base"), F.concat("s3", "s4", "s5").alias("weak")), "found")
    linked = _linked(found).withColumnsRenamed({"doc_id": "doc_id2", "mark": "mark2"})
    joined = found.join(linked, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("mark") == F.col("mark2")), "left")
    return joined.select("doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = find(docs, id_col, text_col)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))
