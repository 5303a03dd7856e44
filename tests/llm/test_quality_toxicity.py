import zlib

import numpy as np
import pytest

from cellweave.llm import quality, toxicity
from tests.llm.helpers import AWKWARD, documents


def made(n):
    """Plain sentences against shouted or symbol-ridden ones; some plain ones hold one of three rude words."""
    rng = np.random.default_rng(4)
    words = ["river", "stone", "green", "walk", "house", "morning", "light", "paper", "cloud", "seven", "under", "garden"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(20, 60))) + "."
        good, toxic = int(i % 3 > 0), int(i % 4 == 1)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " | ".join(text.split()) + "$$$ " * 9
        if toxic:
            text = f"{text} {rng.choice(['blockhead', 'nitwit', 'dullard'])} {rng.choice(words)}"
        docs.append((i, text))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made(900)
    return documents(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (10_000, 1, 0)], "doc_id long, quality int, toxic int"), labels


def test_held_out_quality_is_learned(tables):
    docs, labels, truth = tables
    rows = quality.score_documents(docs, labels).collect()
    label = {i: q for i, q, _ in truth}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_are_never_read(spark, tables):
    docs, labels, truth = tables
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in truth], "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in quality.score_documents(docs, x).collect()) for x in (spark.createDataFrame(truth, flipped.schema), flipped))
    assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)] * 3, [(1, 0, 1), (4, 0, 1)]], ids=["no labels", "ones", "zeros"])
def test_awkward_documents_and_labels_of_one_kind(spark, rows):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    scores = quality.score_documents(docs, labels).collect()
    assert len(scores) == len(AWKWARD) and len({r.score for r in scores}) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == (0 if rows and not rows[0][1] else len(AWKWARD))
    graded = toxicity.grade_documents(docs, labels).collect()
    assert len(graded) == len(AWKWARD) and len({r.severity for r in graded}) == 1
    assert {r.toxic for r in graded} == {1 if rows and rows[0][2] else 0}


def test_empty_tables(spark, tables):
    _, labels, _ = tables
    empty = documents(spark, [])
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.keep_good(empty, labels).count() == 0
    assert toxicity.grade_documents(empty, labels).count() == 0


def test_isotonic_is_the_least_squares_increasing_fit():
    rng = np.random.default_rng(0)
    x = rng.random(200)
    y = (rng.random(200) < x).astype(float)
    at, level = quality.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all()
    # the min-max formula at each point
    order = np.argsort(x)
    s = y[order]
    sums = np.concatenate([[0], np.cumsum(s)])
    fitted = [max(min((sums[b + 1] - sums[a]) / (b + 1 - a) for b in range(i, 200)) for a in range(i + 1)) for i in range(200)]
    assert np.allclose(np.unique(np.round(fitted, 12)), np.round(level, 12))


def test_held_out_toxicity_is_learned(tables):
    docs, labels, truth = tables
    label = {i: t for i, _, t in truth}
    rows = [r for r in toxicity.grade_documents(docs, labels).collect() if r.held_out]
    assert np.mean([r.toxic == label[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.severity <= 3 for r in rows)


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(600)]
    grade = np.array([min(3, len(r) // 1 if 0 in r else 0) for r in rows])
    w, theta = toxicity.fit_ordinal(rows, grade, 6)
    assert (np.diff(theta) > 0).all() and w[0] > 0
    model = toxicity.ToxicityModel({}, theta, 0.0)
    above = model.above(np.array([-5.0, 0.0, 5.0]))
    assert (np.diff(above, axis=1) <= 0).all() and (np.diff(above, axis=0) >= 0).all()


def test_fit_is_where_the_likelihood_is_greatest():
    """Near the fitted weights and thresholds no step along any of them makes the weighted likelihood greater."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(400)]
    grade = np.array([np.clip(int(2 * (0 in r) - (1 in r) + rng.normal(0.5, 1)), 0, 3) for r in rows])
    w, theta = toxicity.fit_ordinal(rows, grade, 5, rounds=3000)
    weight = np.where(grade > 0, 0.5 / (grade > 0).mean(), 0.5 / (grade == 0).mean()) / len(rows)

    def loss(x):
        total = np.array([x[:5][r].sum() for r in rows])
        p = 1 / (1 + np.exp(x[5:][None, :] - total[:, None]))
        over = grade[:, None] > np.arange(3)[None, :]
        return -(weight[:, None] * np.where(over, np.log(p), np.log(1 - p))).sum() + 2e-3 / 10 * (x[:5] ** 2).sum() / 2

    at = np.concatenate([w, theta])
    for k in range(8):
        for step in (-0.05, 0.05):
            assert loss(at + step * np.eye(8)[k]) > loss(at)


def test_made_grades_are_thirds_of_the_toxic_rows():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(900)]
    toxic = np.array([len(r) + rng.normal() > 4.2 for r in rows])
    grade = toxicity.made_grades(rows, toxic, np.arange(900) % 2, 8)
    assert ((grade > 0) == toxic).all()
    sizes = [np.mean([len(r) for r, g in zip(rows, grade, strict=True) if g == k]) for k in (1, 2, 3)]
    assert sizes == sorted(sizes) and all(0.2 < (grade == k).sum() / toxic.sum() < 0.47 for k in (1, 2, 3))


ODD = [*((None if i is None else 20_000 + i, t) for i, t in AWKWARD), (20_050, "nitwit " * 30_000), (20_051, "x" * 200_000), (20_052, "NITWIT, Dullard!\u0130 \U0001f642")]


def test_awkward_documents_by_fitted_models(spark, tables):
    """Null, empty, long and repeated texts: the score is that of plain Python over the whole text."""
    docs, labels, _ = tables
    odd = documents(spark, ODD)
    model, fitted = quality.fit(docs, labels), toxicity.fit(docs, labels)
    assert model.beta is not None and fitted.thresholds is not None

    def severity(text):
        features = {f for w in set(toxicity._WORD((text or "").lower())) for f in toxicity.word_features(w)}
        total = sum(fitted.weights.get(f, 0.0) for f in features)
        return sum(1 / (1 + np.exp(t - total)) for t in fitted.thresholds)

    every = docs.unionByName(odd)
    graded = [r for r in toxicity.grade_documents(every, labels).collect() if r.doc_id is None or r.doc_id >= 20_000]
    assert np.allclose(sorted(r.severity for r in graded), sorted(severity(t) for _, t in ODD), atol=1e-6)
    assert {r.toxic for r in graded if r.doc_id in (20_050, 20_052)} == {1} and {r.toxic for r in graded if r.doc_id in (20_001, 20_002)} == {0}
    scored = [r for r in quality.score_documents(every, labels).collect() if r.doc_id is None or r.doc_id >= 20_000]
    plain = model.score(np.array([quality.statistics(None if t is None else t.encode()) for _, t in ODD]))
    assert np.allclose(sorted(r.score for r in scored), sorted(plain), atol=1e-6)


def test_clashing_columns_in_labels(spark, tables):
    docs, labels, _ = tables
    extra = labels.selectExpr("*", "'x' as text", "1 as y", "2 as fold", "3 as half", "4 as features")
    a = sorted((r.doc_id, round(r.severity, 9)) for r in toxicity.grade_documents(docs, labels).collect())
    assert a == sorted((r.doc_id, round(r.severity, 9)) for r in toxicity.grade_documents(docs, extra).collect())
    assert quality.score_documents(docs, extra).count() == docs.count()


def test_the_fit_is_the_ridge_solution(spark, tables):
    """The model's weights solve the penalised least squares that plain rows state, folds 2 and 3 left out."""
    docs, labels, _ = tables
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(texts[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 < 2 and r.doc_id in texts]
    stats = np.array([quality.statistics(None if t is None else t.encode()) for t, _ in rows])
    y = np.array([q for _, q in rows], float)
    assert np.allclose(model.centre, stats.mean(axis=0)) and np.allclose(model.scale, np.maximum(stats.std(axis=0), 1e-3), atol=1e-5)
    x = np.clip((stats - model.centre) / model.scale, -6, 6)
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(x @ model.weights + model.phase), np.ones((len(x), 1))])
    root = np.sqrt(1e-3 * len(x) / quality.FEATURES) * np.eye(quality.FEATURES + 1)[:-1]
    want = np.linalg.lstsq(np.vstack([z, root]), np.concatenate([y, np.zeros(len(root))]), rcond=None)[0]
    assert np.allclose(z @ model.beta, z @ want, atol=1e-6)
    kernel = np.exp(-0.5 * (0.6**2 / quality.STATISTICS) * ((x[:40, None] - x[None, :40]) ** 2).sum(axis=2))
    assert np.abs(z[:40, :-1] @ z[:40, :-1].T - kernel).mean() < 0.08  # the Gaussian kernel, but for chance
