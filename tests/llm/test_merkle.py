import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from jobspark.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and for each leaf its (left, right) siblings upwards."""
    level, owners, steps = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, over = [], []
        for i in range(0, len(level), 3):
            run = level[i:i + 3]
            for k in range(len(run)):
                for o in owners[i + k]:
                    steps[o].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h("".join(run)))
            over.append(sum(owners[i:i + 3], []))
        level, owners = up, over
    return level[0], steps


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        kept = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[name] = kept, *tree([leaf(r, r[1]) for r in kept])
    root, above = tree([trees[n][1] for n in names])
    out = []
    for name, up in zip(names, above):
        kept, subroot, steps = trees[name]
        for row, own in zip(kept, steps):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            acc = leaf(row, text)
            for left, right in own + up:
                acc = h(left + acc + right)
            out.append((row[0], leaf(row, row[1]), subroot, root,
                        h("".join(a + b for a, b in own + up)), acc, acc == root))
    return sorted(out, key=repr)


def audited(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.audit(df).select(*cols).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [27, 28, 1, 3], [82, 5, 9, 10, 1, 4, 30]])
def test_digests_against_a_plain_tree(spark, sizes):
    rng, rows = random.Random(1), []
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((len(rows), rng.choice(["a\nb", "", "plain", None, "zwölf\n\n"]),
                         rng.choice(["en", None]), f"src{s}", rng.choice([None, 7])))
    assert audited(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_nulls_ties_and_equal_rows(spark):
    rows = [(None, "a\nb", None, None, None), (None, None, None, None, None), (2, "x", "en", "-", 1),
            (2, "x", "en", "-", 1), (2, "y\n", "en", "-", 1), (-5, "\n" * 5000, "en", "", 3),
            (3, "q", "en", "Zé", 1), (4, "q", "en", "a", 1)] + [(9, "same", "en", "hot", 4)] * 60
    assert audited(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\n", "en", "s", 2)], SCHEMA)
    assert merkle.audit(docs.limit(0)).collect() == []
    more = docs.withColumn("digest", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("tree", F.lit(2))
    assert audited(more) == audited(docs)


def test_proofs_carry_siblings_and_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = merkle.proofs(merkle.leaves(docs))
    wrong = out.filter(merkle.fold(F.col("digest")) != F.col("root"))
    assert wrong.count() == 0 and out.count() == docs.count()
    assert out.filter(F.size("path") > 0).count() == docs.count()


def test_only_tampered_texts_with_breaks_fail(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = queries.QUERIES["op11_merkle"](spark, SF).filter("not verified")
    want = docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
                       & F.contains("text", F.lit("\n")))
    assert bad.select("doc_id").exceptAll(want.select("doc_id")).isEmpty()
    assert bad.count() == want.count() > 0
