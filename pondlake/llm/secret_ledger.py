"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256). The ledger, a Parquet
folder that only grows, holds which rule versions have scanned which blob and
what they found. A run scans a blob once, however many rows carry it, and only
with the rule versions that have not seen it; findings are joined back to all
rows. Raising a rule's version, or adding a rule, scans old blobs for that rule alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, ship, sized_join, small


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those that fail ``passes`` are dropped.
    ``needs``: one of these strings occurs, lower-cased, in any text with a match."""
    kind: str
    version: int
    pattern: re.Pattern
    passes: Callable[[re.Match], bool] | None = None
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


def _long_match(m: re.Match) -> bool:
    return len(m[0]) >= 16


#: What a secret looks like, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        _long_value, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), _long_match, ("akia",)),
    Rule("hex", 1, re.compile(r"[0-9a-f]{32,}")),
    Rule("forge", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), None, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), None, ("xox",)),
    Rule("cloud", 1, re.compile(r"AIza[0-9A-Za-z_-]{35}"), None, ("aiza",)),
    Rule("jwt", 1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), None, ("eyj",)),
    Rule("private", 1, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), None, ("private key-----",)),
)
_LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def find(text: str, rules: tuple[Rule, ...]) -> list[dict]:
    """Spans in code points, end exclusive."""
    low, out = None, []
    for rule in rules:
        if rule.needs:
            low = text.lower() if low is None else low
            if not any(s in low for s in rule.needs):
                continue
        out += [{"rule": rule.name, "start": m.start(), "end": m.end()} for m in rule.pattern.finditer(text)
                if rule.passes is None or rule.passes(m)]
    return out


def scan(versions: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: ``doc_id, blob, spans`` (structs ``start, place, kind, end``
    by start, then the kinds' order).

    ``ledger`` is the folder of earlier scans (made if missing; a scratch one if
    None). Null text is the empty blob. Repeated rows share their blob's findings.
    An empty table scans nothing. A run that dies before its ledger rows are
    committed scans them again; a blob scanned twice counts once.
    """
    spark = versions.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ledger")
    ledger = ledger or f"{scratch.root}/blobs"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], _LEDGER).write.parquet(ledger)
    known = spark.read.schema(_LEDGER).parquet(ledger)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    manifest = scratch.write(rows.select("doc_id", "blob"))
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    blobs = manifest.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left")
    todo = scratch.write(blobs.select(
        "blob", "doc_id", F.array_except(names, F.coalesce("seen", F.expr("cast(array() as array<string>)"))).alias("rules"))
        .filter("size(rules) > 0"))
    if not todo.isEmpty():
        # rows that need no scan: other copies of a blob, and blobs without a new rule version
        lists = todo.select("rules").distinct().limit(2).collect()
        skip = scratch.write(sized_join(manifest, todo, ["blob", "doc_id"], "left_anti", 128).distinct())
        if len(lists) == 1 and small(skip, 128):
            wanted = sized_join(rows, skip, ["blob", "doc_id"], "left_anti", 128) \
                .withColumn("rules", F.array(*[F.lit(x) for x in lists[0]["rules"]]))
        else:
            wanted = sized_join(rows, todo, ["blob", "doc_id"], "inner", 256)
        # rows repeated with the blob's own id: one of them is scanned
        again = scratch.write(sized_join(manifest, todo.select("blob", "doc_id"), ["blob", "doc_id"], "left_semi", 128)
                              .groupBy("blob", "doc_id").count().filter("count > 1").select("blob", "doc_id"))
        if not again.isEmpty():
            one = sized_join(wanted, again, ["blob", "doc_id"], "left_semi", 128).groupBy("blob").agg(
                F.first("text").alias("text"), F.first("rules").alias("rules"))
            wanted = sized_join(wanted, again, ["blob", "doc_id"], "left_anti", 128).select("blob", "text", "rules").unionByName(one)
        by_name = {r.name: r for r in rules}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    part = batch.slice(i, 1024)
                    lists = part.column("rules").to_pylist()
                    out = [find(t, tuple(by_name[n] for n in r)) for t, r in zip(part.column("text").to_pylist(), lists)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("blob"), pa.array(lists, pa.list_(pa.string())), pa.array(out, found)],
                        names=["blob", "rules", "findings"])

        wanted.select("blob", "text", "rules").mapInArrow(run, _LEDGER).write.mode("append").parquet(ledger)
        known = spark.read.schema(_LEDGER).parquet(ledger)

    place = {r.name: i for i, r in enumerate(rules)}
    order = F.create_map(*[x for n, i in place.items() for x in (F.lit(n), F.lit(i))])
    current = F.transform(F.filter("findings", lambda f: f["rule"].isin(list(place))), lambda f: F.struct(
        f["start"].alias("start"), F.element_at(order, f["rule"]).alias("place"),
        F.substring_index(f["rule"], "@", 1).alias("kind"), f["end"].alias("end")))
    found = known.filter("size(findings) > 0").withColumn("spans", current).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    found = scratch.write(found)
    out = sized_join(manifest, found, ["blob"], "left", 512)
    return out.select("doc_id", "blob", F.coalesce(
        "spans", F.expr("cast(array() as array<struct<start:int,place:int,kind:string,end:int>>)")).alias("spans"))
