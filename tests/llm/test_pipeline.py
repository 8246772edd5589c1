"""The corpus pipeline stage by stage, against the operators' own results and the public tokenizer library."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from uqframe.llm import bpe, mixing, quality, ranker


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage got and gave, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_filters_keep_what_their_operators_keep(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (a, rules), (b, ranked) = stages[:2]
    assert ids(rules) == ids(quality.judge(a, labels).where("kept")) and 0 < rules.count() < a.count()
    assert ids(ranked) == ids(ranker.judge(b, labels).where("predicted = 1")) and 0 < ranked.count() <= b.count()
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == sorted({c for _, _, c in brute(rows)})


def test_mixing_draws_by_budget(stages):
    before, after = stages[3]
    plan, _ = mixing.draw_plan(before)
    size = {r.doc_id: (r.source, len(r.text.split())) for r in before.collect()}
    given = Counter()
    for k in ids(after):
        given[size[k][0]] += size[k][1]
    for r in plan.collect():
        assert r.budget <= given[r.s[1:]] <= r.budget + max(n for _, n in size.values())


def test_tokens_equal_the_library(stages):
    before, after = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before.select("doc_id", "text").collect():
        t = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(t), hashlib.sha256(" ".join(map(str, t)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_entry_registers_all():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_the_classifier_decides_where_the_rules_left_one_class(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bad = labels.where(~ranker.held_out(F.col("doc_id")) & (F.col("quality") == 0))
    left = docs.join(bad, "doc_id", "left_anti")
    kept = corpus_pipeline.quality_classifier(spark, left, sf_dir)
    want = ranker.judge(docs, labels).where("predicted = 1").join(left, "doc_id", "left_semi")
    assert ids(kept) == ids(want) and 0 < kept.count() < left.count()


def test_stages_on_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (2, None, None, None, None), (3, "", "", "", 0), (None, long + " x", "en", "a", 1), (4, long.upper(), "de", None, 3), (5, " ".join(f"other{i} {i % 7}" for i in range(90)), "en", "b", 4)]
    more = {c: F.lit(i) for i, c in enumerate(("__w", "__row", "__pass", "__id", "__times", "__s", "__n", "score", "k", "N", "__h"))}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns(more)
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = set(map(tuple, docs.collect()))
    for table in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            got = f(spark, table, str(tmp_path))
            assert got.columns == docs.columns and set(map(tuple, got.collect())) <= whole
        got = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
        assert got.count() == table.count()
    rules = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert not {2, 3} & {r.doc_id for r in rules.collect()}  # without words: the base rules reject
    assert Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == {1: 1, 2: 1, 3: 1, None: 1, 5: 1}
