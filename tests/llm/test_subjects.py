import numpy as np
import pytest

from gleanframe.llm import subjects as S
from gleanframe.llm.subject_queries import p9_found
from gleanframe.sources import table


def test_sentences_take_off_wrapping():
    assert S.sentences('{"quality": 8, "shows": "A cat. Two dogs!", "flags": []}')[0].strip(' "') == "A cat."
    assert len(S.sentences("<p>One.</p><p>Two &amp; more</p>\n\n📷\n")) == 2
    assert S.sentences("先是书包。后是红包。") == ["先是书包。", "后是红包。"]
    assert S.sentences("cafÃ© bar") == ["café bar"]
    assert S.sentences(None) == [] and S.sentences("") == [] and S.sentences(" … 123 ") == []
    assert len(S.sentences("word " * 200_000)) == 1


def _toy(n, seed):
    rng = np.random.default_rng(seed)
    words = [["red", "rose", "petal", "stem"], ["goal", "match", "referee", "team"]]
    return [(" ".join(rng.choice(words[k], 5)) + " here today", k) for k in rng.integers(0, 2, n).tolist()]


def test_training_separates_held_out_sentences(spark):
    rows = [(i, "ab"[k], t) for i, (t, k) in enumerate(_toy(300, 1))]
    labelled = S.Labelled.of(spark.createDataFrame(rows, "sample_id int, subject string, text string"), ["a", "b"])
    model = S.first_fit(spark, labelled, 2, rounds=6, passes=10)
    held = _toy(200, 2)
    p = model.scores([S.features(t) for t, _ in held])
    assert (p.argmax(1) == [k for _, k in held]).mean() > 0.98 and ((p > 0.5).sum(1) == 1).mean() > 0.95


def test_packed_words_are_the_features():
    texts = ["One two two.", "", "zwei Wörter, two", "书包 bag", "123"]
    words, has = S.Words.of(texts)
    assert has.tolist() == [True, False, True, True, False]
    for i, text in enumerate([x for x, h in zip(texts, has, strict=True) if h]):
        ids, _ = words.taken(np.array([i]))
        assert [r for w in ids for r in words.rows[words.row_starts[w] :][: words.spans[w]]] == S.features(text)
    model = S.Model.fresh(3, 5)
    assert np.allclose(model.packed_scores(words), model.scores([S.features(x) for x, h in zip(texts, has, strict=True) if h]), atol=1e-5)
    assert len(S.Words.of([])[0].sizes) == 0 and len(S.Words.of(["\n", "…"])[0].sizes) == 0


def test_held_out_labelled_texts(spark):
    """Fit on two thirds of the labelled texts and score the rest; texts name one subject."""
    d = "/root/testdata/sf0.01"
    samples = table(spark, d, "subject_samples")
    model, names = S.train(spark, samples.where("sample_id % 3 > 0"), S.written_blocks(table(spark, d, "documents")))
    held = samples.where("sample_id % 3 = 0").collect()
    top = [names[int(model.scores([f for f in map(S.features, S.sentences(r.text)) if f]).max(0).argmax())] for r in held]
    assert np.mean([t == r.subject for t, r in zip(top, held, strict=True)]) > 0.85


def test_shares_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "goal match team"), (4, "goal match\n" + "nothing of note\n" * 9), (None, "team\n…")], "doc_id bigint, text string")
    model = S.Model.fresh(2)
    model.emb[:] = 0
    for r in S.features("goal match team"):
        model.emb[r, 0] = 5
    model.out[:] = 0
    model.out[0] = [9, -9]
    model.bias[:] = -3
    got = {(r.doc_id, r.subject): r.share for r in S.subject_shares(S.written_blocks(docs), model, ["sport", "other"]).collect()}
    assert got == {(3, "sport"): 1.0, (4, "sport"): pytest.approx(0.1), (None, "sport"): 1.0}
    assert S.subject_shares(S.written_blocks(docs.limit(0)), model, ["sport", "other"]).count() == 0


def test_p9_runs_on_few_documents(spark, tiny):
    got = p9_found(spark, tiny)
    assert got.columns == ["doc_id", "subject"] and got.count() == got.distinct().count() > 20


def _old_rules(p, how):
    """What one document lends, sentence by sentence."""
    n, k = p.shape
    one = np.eye(k)
    if n < 2:
        return []
    seen = np.where(p > S.CLEAR_SCORE, p, 0)
    if how == "rest":
        out = []
        for i in range(n):
            rest = seen.sum(0) - seen[i]
            if rest.sum() >= 0.5:
                share, j = rest / rest.sum(), p[i].argmax()
                out.append((i, one[j] if p[i, j] > 0.5 and share[j] >= 0.3 else share))
        return out
    total = seen.sum(0)
    top = total.argmax()
    if total[top] < S.CLEAR_LEAST or total[top] < S.CLEAR_SHARE * total.sum():
        return []
    if how == "whole":
        return [(i, one[top]) for i in range(n)]
    shown = ((p > 0.5).sum(0) - 1) / (n - 1) >= S.SHARE
    shown[top] = True
    return [(i, one[j] * (p[i, j] > 0.5 and shown[j])) for i, j in enumerate(p.argmax(1))]


@pytest.mark.parametrize("how", ["rest", "whole", "treated"])
def test_lent_labels_by_document(how):
    rng = np.random.default_rng(3)
    docs = [rng.random((n, 3)) ** 4 for n in rng.integers(1, 9, 200)] + [np.array([[0.9, 0, 0]] * 5 + [[0, 0.9, 0]] * 2)]
    at, labels = S.lent_labels(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), how)
    first, want = 0, []
    for d in docs:
        want += [(first + i, y) for i, y in _old_rules(d, how)]
        first += len(d)
    assert at.tolist() == [i for i, _ in want] and np.allclose(labels, [y for _, y in want], atol=1e-6)
    assert len(S.lent_labels(np.zeros((0, 3)), np.zeros(0, np.int64), how)[0]) == 0


def test_all_documents_lend_labels_whole(spark, monkeypatch):
    """Every round reads its slices only; the rounds of a fit together read every sentence of every document."""
    monkeypatch.setattr(S, "ROUND_ROWS", 4_000)
    used = []
    made = S.synchronised
    monkeypatch.setattr(S, "synchronised", lambda m, changes, tasks: used.append(sum(r["n"] for r in changes.select("n").collect())) or made(m, changes, tasks))
    docs = spark.range(10_500).selectExpr("id AS doc_id", "repeat('goal match team\n', if(id = 7, 9000, 2)) AS text")
    samples = spark.createDataFrame([(1, "sport", "goal match"), (2, "other", "red rose")], "sample_id int, subject string, text string")
    labelled = S.Labelled.of(samples, ["other", "sport"])
    lender = S.first_fit(spark, labelled, 2)
    used.clear()
    S.lending_fit(S.written_blocks(docs), labelled, lender, "whole", 3, 4, 1)
    assert len(used) == 4 and sum(used) == 10_499 * 2 + 9_000 + 4 * 2 and max(used) < sum(used)


def test_changes_of_many_tasks_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN_IN", 3)
    model = S.Model.fresh(2)

    def run(batches):
        for b in batches:
            for i in b["id"]:
                trainer = S.Trainer(model)
                trainer.n = int(i) + 1
                trainer.touched[int(i) % 5] = True
                trainer.model.emb[int(i) % 5] += 1
                trainer.model.bias += 2
                yield trainer.change()

    got = S.synchronised(model, spark.range(0, 20, 1, 20).mapInPandas(run, S._CHANGE), 20)
    assert np.allclose(got.emb[:5], model.emb[:5] + 1, atol=1e-5) and np.allclose(got.emb[5:], model.emb[5:])
    assert np.allclose(got.bias, model.bias + 2, atol=1e-5)
    assert S.synchronised(model, spark.createDataFrame([], S._CHANGE), 20) is None


def test_labelled_sample_is_bounded_and_dealt_out(spark, monkeypatch):
    samples = spark.createDataFrame([(i, "ab"[i % 2], f"word{chr(97 + i % 26)} text") for i in range(50)] + [(None, "a", "x"), (60, None, "x"), (61, "a", None)], "sample_id int, subject string, text string")
    labelled = S.Labelled.of(samples, ["a", "b"])
    assert len(labelled.label) == 50 and sum(len(labelled.part(i, 7)[1]) for i in range(7)) == 50
    monkeypatch.setattr(S, "MOST_LABELLED", 10)
    assert len(S.Labelled.of(samples, ["a", "b"]).label) <= 10
    assert len(S.Labelled.of(samples.limit(0), []).label) == 0
