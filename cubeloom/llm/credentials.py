"""Secret scans with multipart credential linking.

A scan of each whole text yields strong spans (an assignment, an access identifier, a long hex run) and weak parts: a bare
secret-like string, an endpoint, a quoted user name. A weak part alone is noise; it is reported only where parts that complete
a credential stand in the same scope. Scopes are stretches of ``SCOPE`` code points. Parts are summed up per document, scope
and role, and a weak part meets the summaries of its own and the neighbouring scopes, so the join takes a few rows per part
however many parts a document holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table, written
from cubeloom.llm.tokens import lean, text_chunks

SCOPE = 400
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LOGINS = ("user", "login", "client_id", "account")
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s\"'<>]+|\b[a-z0-9.-]+\.amazonaws\.com\b")
LOGIN = re.compile(r"""(?:user(?:name)?|login|client_id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
#: Roles: i = identifier, s = secret, e = endpoint. A strong span plays its role too.
ROLE = {"assign": "s", "access": "i", "hex": "s", "bare": "s", "endpoint": "e", "login": "i"}
#: A weak part counts when one of these sets of roles stands near it.
COMPLEMENTS = {"bare": ("i", "e"), "endpoint": ("is",), "login": ("s",)}
SPAN = "struct<kind:string,start:bigint,end:bigint>"
#: Two hashes name a document: as wide as 128 bits, so that no other document's spans are taken for its own.
KEY = "struct<a:bigint,b:bigint>"
FOUND = f"doc_id long, n_assign long, n_access long, n_hex long, base array<{SPAN}>, weak array<{SPAN}>"


def strong_spans(text: str, lower: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strong spans, leftmost and non-overlapping per kind."""
    spans = []
    if any(name in lower for name in NAMES):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def mixed_letters(text: str) -> bool:
    return text.lower() != text != text.upper() and any(c.isdigit() for c in text)


def weak_spans(text: str, lower: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that no strong span overlaps."""
    spans = [("bare", m.start(), m.end()) for m in BARE.finditer(text) if mixed_letters(m.group())]
    if "://" in lower or "amazonaws" in lower:
        spans += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if any(name in lower for name in LOGINS):
        spans += [("login", m.start(), m.end()) for m in LOGIN.finditer(text)]
    if not spans or not strong:
        return spans
    begins = np.array(sorted(s for _, s, _ in strong))
    ends = np.maximum.accumulate(np.array([e for _, _, e in sorted(strong, key=lambda x: x[1])]))

    def free(start: int, end: int) -> bool:
        before = np.searchsorted(begins, end) - 1
        return before < 0 or ends[before] <= start

    return [s for s in spans if free(s[1], s[2])]


def row_key() -> Column:
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with _key, its strong spans (base) and weak parts; written, so the texts are read once.

    Rows of one doc_id and text share _key, and what holds for one holds for the other.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(2)):
                bases, weaks, counts = [], [], np.zeros((hi - lo, 3), np.int64)
                for i, text in enumerate(texts.to_pylist()):
                    lower = text.lower() if text else ""
                    strong = strong_spans(text, lower) if text else []
                    weak = weak_spans(text, lower, strong) if text else []
                    for name, _, _ in strong:
                        counts[i, KINDS.index(name)] += 1
                    bases.append([{"kind": k, "start": s, "end": e} for k, s, e in strong])
                    weaks.append([{"kind": k, "start": s, "end": e} for k, s, e in weak])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(counts[:, j].copy()) for j in range(3)),
                     pa.array(bases, kind), pa.array(weaks, kind)],
                    names=["_key", "doc_id", "n_assign", "n_access", "n_hex", "base", "weak"],
                )

    rows = docs.select(row_key().alias("_key"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(lean(find), f"_key {KEY}, {FOUND}"), "secret-spans")


def _marked(weak: bool):
    return lambda s: F.struct(s.alias("span"), F.lit(weak).alias("weak"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_key, linked: the weak parts that stand within ``scope`` code points of the parts that complete them."""
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    parts = found.filter(F.size("weak") > 0).dropDuplicates(["_key"])
    listed = F.concat(*[F.transform(c, _marked(w)) for c, w in (("base", False), ("weak", True))])
    parts = parts.select("_key", F.explode(listed).alias("p")).select("_key", "p.span.*", "p.weak")
    parts = parts.withColumns({"role": role[F.col("kind")], "scope": F.floor(F.col("start") / scope).cast("long")})
    # first and last start of a scope and role tell whether any part of it lies within reach on either side
    sums = parts.groupBy("_key", "scope", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    around = F.explode(F.array(F.col("scope") - 1, F.col("scope"), F.col("scope") + 1))
    reach = sums.select("_key", around.alias("scope"), F.struct("role", "lo", "hi").alias("near"))
    reach = reach.groupBy("_key", "scope").agg(F.collect_list("near").alias("near"))  # at most three roles of three scopes
    weak = parts.filter("weak").join(reach, ["_key", "scope"])

    def has(wanted: str) -> Column:
        start = F.col("start")
        return F.exists("near", lambda n: (n["role"] == wanted) & ((F.abs(n["lo"] - start) <= scope) | (F.abs(n["hi"] - start) <= scope)))

    complete = F.lit(False)
    for kind, sets in COMPLEMENTS.items():
        for wanted in sets:
            every = F.col("kind") == kind
            for one in wanted:
                every = every & has(one)
            complete = complete | every
    return weak.filter(complete).groupBy("_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def _found(docs: DataFrame, scope: int) -> DataFrame:
    found = scan(docs)
    linked = F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))
    return found.join(link(found, scope), "_key", "left").withColumn("linked", linked).drop("weak")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base (strong spans) and linked (weak parts with their complements).

    Spans are arrays of (kind, start, end) in code points, end exclusive. Null and empty texts have none; null ids are kept;
    repeated rows are scanned one by one; columns besides doc_id and text are not read; an empty table gives no rows.
    """
    return _found(docs, scope).drop("_key")


def mask_secrets(docs: DataFrame, sign: str = "*", scope: int = SCOPE) -> DataFrame:
    """The documents with every code point of a base span or linked part replaced by ``sign``; the columns stay as they are, whatever their names."""
    spans = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    hits = _found(docs, scope).filter("size(base) + size(linked) > 0").select(F.col("_key").alias("_hit"), spans.alias("_spans"))
    # the caller's columns travel in one struct, so that no name of theirs meets one of these
    carried = docs.select(row_key().alias("_key"), F.struct(*docs.columns).alias("_row"))
    joined = carried.join(hits.dropDuplicates(["_hit"]), F.col("_key") == F.col("_hit"), "left")
    text = F.col("_row")["text"]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        begin, end = F.greatest(state["at"], span["start"]), F.greatest(state["at"], span["end"])
        plain = F.substring(text, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(state["out"], plain, F.repeat(F.lit(sign), (end - begin).cast("int"))).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    hidden = F.when(F.col("_spans").isNull(), text).otherwise(F.aggregate("_spans", start, step, finish))
    return joined.select(*[hidden.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    places = F.array(*map(F.lit, ROLE))
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(places, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts, the checksum of the base spans and the list of all spans, in text order."""
    return find_secrets(docs, scope).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
    )


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))
