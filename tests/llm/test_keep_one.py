"""Near duplicates as a stage: repeated ids, clashing column names, empty tables, and no table left behind."""
from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapscope.llm import neardup
from gapscope.llm.common import prepare
from gapscope.session import shared_dir

LONG = " ".join(f"w{i}" for i in range(60))
NEAR = LONG.replace("w59", "other")
OTHER = " ".join(f"v{i}" for i in range(30))
SCHEMA = "doc_id long, text string, __id int, __kept boolean, row string, same string, k1 long, kept string"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, n, False, str(n), "s", 1, "k") for n, (i, t) in enumerate(rows)], SCHEMA)


def test_texts_of_one_id_are_told_apart(spark):
    rows = [(3, LONG), (3, OTHER), (4, NEAR), (5, OTHER + " tail"), (6, "alone"), (6, "alone"), (7, None), (7, None), (7, ""), (None, LONG), (None, LONG), (8, LONG)]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(3, LONG), (3, OTHER), (6, "alone"), (7, None), (7, ""), (None, LONG), (None, LONG)], key=repr)


def test_columns_and_choice_are_the_same_whatever_the_partitions(spark):
    rows = [(1, LONG)] * 5 + [(2, LONG)] * 3 + [(9, OTHER)]
    docs = frame(spark, rows)
    one, many = neardup.keep_one(docs.coalesce(1)), neardup.keep_one(docs.repartition(7))
    assert one.columns == docs.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 2


def test_empty_table(spark):
    docs = frame(spark, [(1, LONG)]).filter("false")
    assert neardup.keep_one(docs).columns == docs.columns and neardup.keep_one(docs).collect() == []


def test_finished_tables_are_removed(spark):
    """Of all intermediate tables only those stay that the result is read from."""
    place = shared_dir(spark)
    before = set(os.listdir(place))
    neardup.link_groups(frame(spark, [(i, LONG if i % 2 else NEAR) for i in range(40)] + [(99, OTHER)])).collect()
    assert len(set(os.listdir(place)) - before) == 3


@pytest.mark.parametrize("share", [(80, 100), (85, 100)])
def test_wide_clusters_against_all_pairs(spark, share):
    """Texts whose similarity to one another runs from half to nearly all: many pairs just below the threshold."""
    import random
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(140):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            at = rng.randrange(len(words))
            words[at] = f"x{rng.randrange(12)}"
        texts[i] = " ".join(words)
    prepare(spark)
    got = {r.doc_id: r.component_id for r in neardup.link_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, share).collect()}
    sets = {i: {tuple(t.split()[k:k + 3]) for k in range(148)} for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in texts:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in texts} and len(set(got.values())) > 20


def test_keys_of_a_task_are_bounded(spark, monkeypatch):
    """Nodes that lie in one file are dealt out, so that a task's aggregation stays small; the keys and their nodes are all there."""
    monkeypatch.setattr(neardup, "TASK_KEYS", 2000)
    prepare(spark)
    docs = spark.createDataFrame([(i, f"{LONG} {i} {i * i}") for i in range(100)], "doc_id long, text string").coalesce(1)
    width = neardup.table_width(0.8)
    nodes = neardup.signatures(docs, 5, width).withColumnRenamed("doc_id", "node")
    keys = neardup.table_keys(nodes, width).withColumn("task", F.spark_partition_id()).collect()
    tasks = Counter(r.task for r in keys)
    assert width == 14 and len(keys) == 100 * width ** 2 and len(tasks) >= 7 and max(tasks.values()) <= 3 * 2000
    assert set(Counter(r.node for r in keys).values()) == {width ** 2}
    linked = Counter(r.key for r in keys)
    assert max(linked.values()) > 50  # near copies meet
