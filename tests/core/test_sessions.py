"""Sessions, file dates and paragraphs on small tables, against a plain version."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from lakewright.operators import sessions


def plain_choice(text, words, most):
    text = text or ""
    if len(re.sub(r"\s+", " ", text).strip()) <= most:
        return text.strip()
    parts = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
    if len(parts) <= 1:
        own = text.strip()
        head = own[:most]
        at = max(head.rfind(". "), head.rfind("\n"))
        return own if len(own) <= most else (head[: at + 1] if at > most * 0.6 else head).strip() + "\n\n[truncated]"
    order = sorted(range(len(parts)), key=lambda i: (-((2 if i == 0 else 0) + sum(w in parts[i].lower() for w in words)), i))
    taken, used = [], 0
    for i in order:
        if used + len(parts[i]) + 2 > most and taken:
            continue
        taken.append(i)
        used += len(parts[i]) + 2
        if used >= most:
            break
    return "\n\n".join(parts[i] for i in sorted(taken))[:most].strip()


def test_relevant_text(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "rest", "more", "text"]
    texts = [None, "", "  short ", "x" * 200, "one two. " * 30, "a\nb " * 60]
    texts += ["\n\n".join(" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    asked = ["alpha", "gamma", "delta"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dict(df.select("id", sessions.relevant_text(F.col("text"), [*asked, "no"], 90)).collect())
    assert got == {i: plain_choice(t, asked, 90) for i, t in enumerate(texts)}


def test_session_contexts(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", k, at + dt.timedelta(minutes=k), *r) for k, r in enumerate([("user", None, 9000), ("assistant", "m", 50), ("compaction", None, None), ("assistant", "n", 400), ("compaction", None, 900)])]
    rows += [("b", 0, at, "user", None, None)]
    entries = spark.createDataFrame(rows, "session string, place long, at timestamp, kind string, model string, tokens long")
    windows = spark.createDataFrame([("m", 1000)], "model string, window long")
    got = {r.session: r for r in sessions.session_contexts(entries, windows).collect()}
    a, b = got["a"], got["b"]
    assert (a.model, a.window, a.most_tokens, a.first_tokens, a.turns, a.answers, a.compactions, a.minutes) == ("n", 1000, 900, 50, 1, 2, 2, 4.0)
    assert (a.most_share, a.first_share) == (90.0, 5.0)
    assert (b.model, b.most_tokens, b.most_share) == (sessions.UNKNOWN_MODEL, None, None)
    assert sessions.context_summary(sessions.session_contexts(entries.limit(0), windows)).count() == 0


def test_birth_calibration(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([(d(1), [d(1), d(9)]), (d(1), [d(2)]), (d(5), []), (None, [d(3)])], "birth date, stated array<date>")
    r = sessions.birth_calibration(df, "birth", "stated").first()
    assert (r.files, r.with_birth, r.labelled, r.same_day, r.within_a_day) == (4, 3, 2, 1, 2)
    assert (r.agreement, r.loose_agreement, r.clustered, r.top_days) == (0.5, 1.0, 0.6667, ["2024-01-01=2", "2024-01-05=1"])
    r = sessions.birth_calibration(df.limit(0), "birth", "stated").first()
    assert (r.files, r.agreement, r.clustered, r.top_days) == (0, None, None, [])


def test_relevant_text_names_its_text_once(spark):
    df = spark.createDataFrame([("One two.\n\nÉtat of things, e-mail\n\n" * 9,), (None,)], "text string")
    found = df.select(sessions.relevant_text(F.upper("text"), ["etat", "e-mail", "e mail"], 40).alias("t"))
    assert [r.t for r in found.collect()] == ["ONE TWO.\n\nÉTAT OF THINGS, E-MAIL"[:40], ""]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
