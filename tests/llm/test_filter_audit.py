"""Filter audit against filters applied one by one in every order."""

import itertools
import re
from collections import Counter

import pytest

from uqframe.llm import filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, part string, same string, A int"
LABELS = "doc_id bigint, quality int, toxic int"


def verdicts(docs, labels):
    """(part, set of failing filters, good, toxic) of (doc_id, text, lang) rows."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    out = []
    for k, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": k is not None and k > first[t],
        }
        out.append((lang or "", frozenset(f for f, x in fails.items() if x), k in good, k in toxic))
    return out


def audited(rows, filters="ABCDE"):
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = Counter()
        for order in itertools.permutations(filters):
            alive = own
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in alive if f in r[1]], [r for r in alive if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [f, len(kept), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed_by[f] += len(gone)
                alive = kept
        for order in itertools.permutations(filters):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_by[f])
    return out


def found(rows):
    return {(r.part, r.filter_order, r.step): [r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "x", "y", 1) for d in docs], DOCS).repartition(4), spark.createDataFrame(labels, LABELS)


def text(i):
    words = [f"w{j}" for j in range(130)]
    return ["", " \n", "short one", " ".join(words), " ".join(words[:40] * 4), " ".join(words).upper(), " ".join(words) + " #", "É" * 500 + " AB", " ".join(words) + " x", "A" * 20 + " " + "b " * 99][i % 10]


def test_every_order_against_plain_lists(spark):
    docs = [(i, text(i), [None, "", "en", "de"][i % 4]) for i in range(80)] + [(200 + i, text(3), "en") for i in range(60)]
    docs += [(None, text(3), "en"), (None, "only null keys", "x"), (None, "only null keys", "x"), (5, text(3), "de"), (5, text(3), "de"), (300, None, "en"), (301, text(3) * 400, "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(90)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (200, None, 1)]
    labels = [(k, q, None if t is None else int(t)) for k, q, t in labels]
    d, l = frames(spark, docs, labels)
    rows = filter_audit.document_verdicts(d, l)
    got = filter_audit.audit(rows, list("ABCDE"), ["good", "toxic"])
    rows_ = got.collect()
    assert len(rows_) == 600 * len({r.part for r in rows_})
    assert found(rows_) == audited(verdicts(docs, labels))


def test_hot_groups_take_the_other_join(spark, monkeypatch):
    docs = [(i, text(3) if i % 3 else text(4), "en") for i in range(60)] + [(100 + i, f"t{i % 20}", "en") for i in range(40)]
    d, l = frames(spark, docs, [])
    expect = sorted(filter_audit.document_verdicts(d, l).collect())
    monkeypatch.setattr(filter_audit, "HOT_ROWS", 10)
    monkeypatch.setattr(filter_audit, "MOST_HOT", 10)
    assert sorted(filter_audit.document_verdicts(d, l).collect()) == expect
    assert sum(r.E for r in expect) == sum("E" in v[1] for v in verdicts(docs, []))


def test_each_state_is_counted_once(spark):
    rows = spark.createDataFrame([("p", True, False, True), ("p", False, True, False), ("q", False, False, False), ("q", None, True, True)], "part string, a boolean, b boolean, c boolean")
    edges = filter_audit.walk(rows.fillna(False), ["a", "b", "c"], [], "part")
    states = Counter(r.state for r in edges.where("part = 'q'").collect())
    assert states == {"": 3, "a": 2, "b": 2, "c": 2, "a,b": 1, "a,c": 1, "b,c": 1}
    one = filter_audit.audit(rows, ["a"], []).collect()
    assert sorted((r.part, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in one) == [("p", 1, 1, 0, 1, 1), ("q", 2, 0, 0, 0, 0)]
    two = filter_audit.audit(rows, ["b", "a"], []).collect()
    assert {(r.part, r.filter_order, r["filter"]): r.removed for r in two}["p", "ba", "a"] == 1


def test_empty_table_and_too_many_filters(spark):
    d, l = frames(spark, [], [])
    rows = filter_audit.document_verdicts(d, l)
    assert filter_audit.audit(rows, list("ABCDE"), ["good", "toxic"]).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(rows, ["A"] * 8, [])


def test_whole_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(queries.op11_filter_audit(spark, sf_dir).collect()) == audited(verdicts(docs, labels))
