"""Merkle manifest against trees built in memory."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pondlake.llm import merkle
from tests.llm import helpers as h


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], fanout: int) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree: list[list[str]], i: int, fanout: int) -> str:
    out = ""
    for level in tree[:-1]:
        first = i - i % fanout
        out += "".join(x for k, x in enumerate(level[first:first + fanout]) if first + k != i)
        i //= fanout
    return out


def leaf_of(row) -> str:
    doc_id, text, lang, source, n = row[:5]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def leaves(df):
    return df.withColumn("leaf", merkle.digest(merkle.leaf_text([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])))


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_roots_and_proofs_equal_a_tree_in_memory(spark, fanout):
    rows = h.awkward_rows()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r)))
    order = sorted(groups, key=lambda x: (x is not None, x or ""))
    trees = {g: levels([x for _, x in sorted(groups[g])], fanout) for g in order}
    top = levels([trees[g][-1][0] for g in order], fanout)
    want = sorted((g or "", x, trees[g][-1][0], siblings(trees[g], i, fanout), siblings(top, k, fanout))
                  for k, g in enumerate(order) for i, x in enumerate(trees[g][0]))
    # clashing names beside the ones that are read
    docs = leaves(h.awkward(spark)).withColumn("proof", F.lit(1)).withColumn("root", F.lit(2)).withColumn("idx", F.lit(3))
    out, name = merkle.manifest(docs, "leaf", "lang", "doc_id", fanout)
    assert name == "proof_" and out.columns == [*docs.columns, name]
    back = out.select(F.coalesce("lang", F.lit("")), *[merkle.hexed(c) for c in (
        F.col("leaf"), F.col(name)["subroot"], F.col(name)["siblings"], F.col(name)["group_siblings"], F.col(name)["root"],
        merkle.verify(F.col("leaf"), name, fanout), merkle.verify(merkle.digest(F.lit("other")), name, fanout))]).collect()
    assert sorted(tuple(r)[:5] for r in back) == want
    assert {r[5] for r in back} == {top[-1][0]} == {r[6] for r in back}
    assert top[-1][0] not in {r[7] for r in back}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_one_group_of_any_width(spark, n):
    docs = spark.range(n).select("id", F.lit(None).cast("string").alias("g"), merkle.digest(F.col("id").cast("string")).alias("leaf"))
    out, name = merkle.manifest(docs, "leaf", "g", "id")
    tree = levels([H(str(i)) for i in range(n)], 2)
    got = out.select("id", merkle.hexed(F.col(name)["root"]), merkle.hexed(F.col(name)["siblings"]), F.col(name)["position"]).collect()
    assert sorted(map(tuple, got)) == [(i, tree[-1][0], siblings(tree, i, 2), i) for i in range(n)]


def test_a_third_of_all_rows_alike(spark):
    """Equal rows are leaves of their own, and every one verifies."""
    docs = spark.range(600).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("id"), F.lit("x").alias("g"))
    docs = docs.withColumn("leaf", merkle.digest(F.col("id").cast("string"))).repartition(6)
    out, name = merkle.manifest(docs, "leaf", "g", "id")
    tree = levels([H(str(i)) for i in sorted(7 if i % 3 == 0 else i for i in range(600))], 2)
    got = out.select(F.col(name)["position"], merkle.hexed(merkle.verify(F.col("leaf"), name))).collect()
    assert sorted(r[0] for r in got) == list(range(600)) and {r[1] for r in got} == {tree[-1][0]}


def test_empty_table(spark):
    assert merkle.manifest(leaves(h.empty(spark)), "leaf", "lang", "doc_id")[0].count() == 0
