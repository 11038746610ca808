import re

import pandas as pd

from riskweave.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    inside = {p + k for starts in windows.values() if len(starts) > 1 for p in starts for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


ODD = [None, "", " \t\n\x0b\x0c\r ", "a\n a\na\n\n\na", "x\x1cy x y", "a b c a b c a b", "é " * 60, "one", "#*$%&|<> \n#", "\r\na b\r\na b"]


def test_counts_equal_plain_python(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [*zip(docs.doc_id.tolist(), docs.text), *((1000 + i, t) for i, t in enumerate(ODD)), (None, "a"), (1, "x"), (1, "x")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    got = sorted([tuple(r) for r in Q.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()], key=str)
    assert got == sorted([(i, *base(t)) for i, t in rows], key=str)


def test_lines_that_go(spark):
    prose = "The river runs to the sea and the town lies where both of them meet."
    bad = ["Home | News | Sport | Weather | Contact", "BUY NOW AND SAVE ALL OF YOUR MONEY", "a# b$ c% d& e* f|", "spam " * 20,
           "All rights reserved.", "menu item"]
    good = [prose, "", "He wrote a short list of what he had seen", "Really?", "NASA and the ESA agreed on it."]
    df = spark.createDataFrame([(1, "\n".join(x for pair in zip(good, bad) for x in pair) + "\n" + bad[-1])], "doc_id long, text string")
    assert Q.judge(df).first().cleaned.split("\n") == good


def test_verdicts_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    decided = judged[~judged.base_failed]
    assert (decided[decided.quality == 1].kept).all()
    assert (decided[decided.quality == 0].kept).mean() < 0.05


def test_cleaned_keeps_columns_and_no_python_in_the_plan(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, prose + "\nHome | a | b | c", 0, "x"), (2, "short", 0, "y")], "doc_id long, text string, n_chars int, examined string")
    kept = Q.cleaned(df)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [(1, prose, len(prose), "x")]
    assert not re.search("Python|Arrow|Pandas", kept._jdf.queryExecution().toString())
    assert Q.judge(df.limit(0)).collect() == []
