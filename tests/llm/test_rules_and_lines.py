import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from growthlens.llm import line_dedup, quality_rules

from .conftest import HARD, WS, low, texts_frame

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (t or "").split("\n") if x.strip(WS)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def check_rules(df, rows):
    got = Counter((r.doc_id, *(r[c] for c in BASE), r.base_failed) for r in quality_rules.quality_rules(df).collect())
    want = Counter()
    for i, t in rows:
        m = measured(t)
        want[(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want


def test_rules_against_brute_force(docs, doc_rows):
    check_rules(docs, doc_rows)


def test_rules_on_hard_texts(spark):
    df, rows = texts_frame(spark)
    check_rules(df, rows)
    assert "mine" == quality_rules.quality_rules(df).first()["entry"]


def test_lines_are_compared_with_their_white_space(spark):
    texts = [" a line\na line", "a line\na line ", "\ta line\n\ta line", " x\n x\nx"]
    check_rules(*texts_frame(spark, texts))


def test_rules_empty_table(no_docs):
    out = quality_rules.quality_rules(no_docs)
    assert out.count() == 0 and {"kept", "base_failed", "failed_rules", *BASE} <= set(out.columns)


def test_rules_use_no_python_and_stay_one_scan(docs):
    plan = quality_rules.quality_rules(docs).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_threshold_can_fail(spark):
    prose = "the cat and the dog went to sea in a small green boat of wood with some honey"
    bad = {"symbols": "#a " * 6 + prose, "short_words": "a b c d e f g h i j k l m n",
           "long_words": " ".join(f"{chr(97 + i)}" * 25 for i in range(12)),
           "few_stop_words": " ".join(f"zq{i}" for i in range(60)),
           "repeated_lines": "\n".join(["the one", "the two and"] * 6), "too_few_words": "too few", "repeated_windows": "a bc de fg hi jk " * 5}
    df = spark.createDataFrame([*bad.items(), ("", prose)], "doc_id string, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert got[""].kept and not got[""].failed_rules
    for name in bad:
        assert name in got[name].failed_rules and not got[name].kept


def dedup(rows):
    holders = defaultdict(set)
    key = lambda x: low(x.strip(WS))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                holders[key(x)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def deduped(df):
    out = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h"))
    return Counter(map(tuple, out.collect()))


def test_lines_against_brute_force(docs, doc_rows):
    assert deduped(docs) == dedup(doc_rows)


def test_lines_on_hard_texts(spark):
    df, rows = texts_frame(spark)
    assert deduped(df) == dedup(rows)


def test_lines_null_ids_and_clashing_rows(spark):
    rows = [(None, "a line that is shared"), (None, "a line that is shared"), (5, "a line that is shared\nx"),
            (5, "y\nz\na line that is shared"), (7, "a line that is shared"), (3, "\t A LINE that is shared \nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduped(df) == dedup(rows)


def test_lines_common_to_many_documents(spark):
    rows = [(i, f"the line in every document\nown line number {i}\nthe line in every document") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert deduped(df) == dedup(rows)


def test_lines_threshold(spark):
    rows = [(i, "shared by just two documents" if i < 2 else "shared by more than two documents") for i in range(6)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_lines_empty_table_and_native_plan(no_docs, docs):
    assert line_dedup.line_dedup(no_docs).count() == 0
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, stage):
    texts = HARD + ["\n".join(f"a clean line of the text number {i} and of part {k}" for k in range(9)) for i in range(4)]
    df, _ = texts_frame(spark, texts)
    out = corpus_pipeline.STAGES[stage][1](spark, df, "/root/testdata/sf0.001")
    assert out.columns == df.columns and {r.kept for r in out.collect()} == {"mine"}
