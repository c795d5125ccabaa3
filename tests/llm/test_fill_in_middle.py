"""Fill-in-the-middle rows against a plain version; boundary lists against decoded texts."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewright.llm import fill_in_middle as M

DOCS = "doc_id long, text string, name string, part int, size long"


def plain_row(doc_id, text, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé日😀<PSM>", max_size=700), st.integers(1, 12))
def test_boundary_lists(text, times):
    text = text * times
    found = M.Boundaries(*M.Boundaries.encode(text.encode()))
    want = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert [found[k] for k in range(found.count)] == want


def test_rows_match_plain_version(spark):
    texts = [None, "", "a", "日本", "x<P>y", "<<S", "S><M", "é😀" * 4000, "word " * 60_000, "same text", "same text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (None, None)]
    rows += [(1000 + i, "hot copy é") for i in range(700)] + [(5000 + i, f"text {i} ü") for i in range(300)]
    df = spark.createDataFrame([(d, t, "n", 1, 2) for d, t in rows], DOCS).repartition(5)
    got = M.transform(df).collect()
    want = [plain_row(d, t) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    texts_of = {}
    for d, t in rows:
        texts_of.setdefault(d, set()).add(hashlib.sha256((t or "").encode()).hexdigest())
    assert all(r.restored_sha256 in texts_of[r.doc_id] and r.output_sha256 == hashlib.sha256(bytes(r.output)).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_index_holds_each_text_once_and_hot_rows_are_dealt(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(900)] + [(i, f"t{i}") for i in range(50)] + [(1, None)], "doc_id long, text string")
    index = M.build_index(df)
    assert index.count() == 52 and index.agg(F.sum("copies")).first()[0] == 951
    assert M.transform(df, index, keep_output=False).count() == 951
    assert M.transform(df.limit(0)).count() == 0
