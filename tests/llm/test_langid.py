import pytest

pytest.importorskip("tapewright.llm")

import numpy as np  # noqa: E402

from tapewright.llm import langid  # noqa: E402
from tapewright.llm.langid import LANGUAGES, WINDOW, ByteNet, batched_log_probs, detect, fit_tables, judge, label_language, line_scores, prose_lines, to_bytes, train, windows_of, wrong_labels  # noqa: E402


MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    """Trained as in production, on the middle tables."""
    return fit_tables(spark, spark.read.parquet(f"{MIDDLE}/lang_samples.parquet"), spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def test_labels():
    for text, code in (("EN", "en"), ("pt-BR", "pt"), ("fr_FR", "fr"), ("Deutsch", "de"), (" dut ", "nl"), ("n/a", None), ("und", None), ("", None), (None, None), ("sv", None), ("Русский", "ru")):
        assert label_language(text) == code


def test_prose_without_code_links_numbers():
    text = "Hello there\n\n```\nint x = 1;\n```\n    indented code here\nsee https://a.example/b?c=d\n+2\nUse `foo bar` and run_it() now"
    got = prose_lines(text)
    assert [n for n, _ in got] == [1, 7, 9]
    assert "foo" not in got[2][1] and "run_it" not in got[2][1]
    assert prose_lines(None) == prose_lines("") == []


def test_held_out_accuracy(spark, sf, net):
    # Other rows than those trained on; their labels are mostly right.
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 5 = 0").select("text", "lang").collect()
    lines = [(label_language(r["lang"]), prose_lines(r["text"])) for r in rows]
    lines = [(c, p) for c, p in lines if c and sum(len(x) for _, x in p) >= 20]
    hits = 0
    for c, p in lines:
        main, _, _ = judge(p, line_scores(net, [to_bytes(x) for _, x in p]))
        hits += LANGUAGES[main] == c
    assert hits / len(lines) > 0.88  # a thirteenth or so of the labels is wrong


def test_gradient_lowers_loss():
    texts = [b" the cat and the dog ", b" der hund und die katze "] * 20
    labels = np.array([LANGUAGES.index("en"), LANGUAGES.index("de")] * 20)
    small = train(texts, labels, np.ones(40), steps=60)
    s = line_scores(small, texts[:2])
    assert s[0].argmax() == labels[0] and s[1].argmax() == labels[1]


def test_edge_rows(spark, net):
    rows = [
        (1, None, "en", "x"), (2, "", None, "x"), (3, "    code only\n\n+1", "en", "x"), (4, "The second worker repeats the session profile only once.", "de", "x"),
        (4, "The second worker repeats the session profile only once.", "de", "x"), (5, "The old export loses the collector log.\nDer alte Export rundet das Protokoll ohne guten Grund.\nThe test run sends the closing price as expected.", "EN", "x"),
        (6, "word " * 60_000, "en", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, line_no string")
    found = detect(df, net)
    assert {r["doc_id"] for r in found.filter("line_no = 0 and lang is null").collect()} == {1, 2, 3}
    wrong = {(r["doc_id"], r["line_no"], r["lang"]) for r in wrong_labels(found).collect()}
    assert (4, 0, "en") in wrong and (5, 2, "de") in wrong and not any(d == 5 and n != 2 for d, n, _ in wrong)
    assert detect(df.limit(0), net).count() == 0


def test_windows_cover_and_weigh():
    for n in (2, 50, 96, 97, 192, 250):
        data = bytes(1 + i % 250 for i in range(n))
        parts = windows_of(data)
        assert all(len(p) == min(n, WINDOW) for p, _ in parts) and abs(sum(w for _, w in parts) - max(n / WINDOW, 1)) < 1e-9
    assert len(windows_of(b" ")[0][0]) > 1


def test_a_window_does_not_depend_on_those_beside_it(net):
    parts = [b" " + bytes([97 + i % 26]) * k + b" der hund " for i, k in enumerate(range(1, 80))]
    together = batched_log_probs(net, parts)
    alone = [batched_log_probs(net, [p])[0] for p in parts]
    assert np.abs(together - np.array(alone)).max() < 1e-6


def test_same_rows_however_partitioned(spark, sf, net):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for n, batch in ((1, "10000"), (4, "7"), (50, "10000")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got.append(sorted(map(tuple, detect(docs.repartition(n), net).drop("label").collect()), key=str))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_weights_are_stored(spark, sf, net, monkeypatch):
    copy = ByteNet.load(net.save())
    assert all(np.array_equal(getattr(copy, k), v) for k, v in vars(net).items())
    monkeypatch.setattr(langid, "fit", lambda *_: 1 / 0)
    again = fit_tables(spark, spark.read.parquet(f"{MIDDLE}/lang_samples.parquet"), spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    assert np.array_equal(again.filters, net.filters)


def test_judging_ends_and_agrees():
    """Random scores: the main language is one of most letters under its own reading of the lines, or none is."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        letters = rng.integers(2, 60, n).astype(float)
        raw = rng.normal(0, 3, (n, len(LANGUAGES)))
        main, confidence, out = judge([(i + 1, "x") for i in range(n)], raw, None, letters)
        assert 0 <= confidence <= 1 and [k for k, _, _ in out] == list(range(1, n + 1)) and 0 <= main < len(LANGUAGES)


def one_by_one(letters, scores, label):
    """``judge_all`` for a document in plain Python."""
    n, k = len(letters), len(LANGUAGES)

    def post(row, of, share, weight=1.0):
        x = [v + (0 if of is None else weight * np.log(share if c == of else (1 - share) / (k - 1))) for c, v in enumerate(row)]
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    main = int(np.argmax(sum(a * post(r, label, langid.LABEL_PRIOR, 1 / n) for a, r in zip(letters, scores))))
    seen = {}
    while main not in seen:
        lang = [int(p.argmax()) if p[main] <= langid.LINE_POSTERIOR else main for p in (post(r, main, langid.MAIN_PRIOR) for r in scores)]
        share = np.bincount(lang, weights=letters, minlength=k)
        seen[main] = (share[main], lang)
        if share[main] >= share.max():
            return main, lang
        main = int(share.argmax())
    best = min(m for m in seen if seen[m][0] == max(x for x, _ in seen.values()))
    return best, seen[best][1]


def test_documents_are_judged_alike_together_and_alone():
    rng = np.random.default_rng(9)
    counts = rng.integers(1, 7, 400)
    letters, scores = rng.integers(2, 60, counts.sum()).astype(float), rng.normal(0, 3, (counts.sum(), len(LANGUAGES)))
    labels = rng.integers(0, len(LANGUAGES) + 1, 400)
    main, _, lang, _ = langid.judge_all(counts, scores, letters, labels)
    at = 0
    for i, n in enumerate(counts):
        m, ls = one_by_one(letters[at : at + n], scores[at : at + n], None if labels[i] == len(LANGUAGES) else int(labels[i]))
        assert main[i] == m and lang[at : at + n].tolist() == ls, i
        at += n
