import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, quality, toxicity
from lodestone.llm.fingerprint import Powers

from .fixtures import TEXTS, frame

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_held_out(spark, docs):
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark, docs):
    edge = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate([*TEXTS, "123 !!"])] + [(None, None, "en")], "doc_id long, text string, lang string")).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(edge, per_language=60, carry=True).where("doc_id is null or doc_id >= 1000000").collect()}
    for i, t in enumerate([*TEXTS, "123 !!"]):
        assert (got[10**6 + i].lang_pred == "und") == (not language.has_letter(t))
    assert got[None].lang_pred == "und" and got[None]["_carried3"] == "clash"
    none = language.identify(frame(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


def test_kernel_margins_are_the_kernel():
    texts, langs = ["the cat sat", "le chat noir", "the dog ran", "la chatte grise"] * 5, ["en", "fr"] * 10
    model = language.fit(texts, langs, n_landmarks=8)
    assert model.predict(["the rat", "le rat gris"])[0] == ["en", "fr"]
    assert np.allclose(model.margins(texts, rows=3), model.margins(texts, rows=64))


def test_margins_equal_explicit_kernels():
    """Kernels by sets of strings, the ridge solved in the landmarks' span, against the folded weights."""
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 6)))
    langs = ["aa", "bb", "cc"] * 12
    texts = [" ".join(word({"aa": "abcde", "bb": "defgh", "cc": "xyzé"}[g]) for _ in range(6)) for g in langs]
    model = language.fit(texts, langs, n_landmarks=9, ridge=1e-2)
    marks = sorted(i for g in sorted(set(langs)) for i in [j for j, x in enumerate(langs) if x == g][:3])

    def grams(t, n):
        s = language.symbols(t).tolist()
        return {tuple(s[i : i + n]) for i in range(len(s) - n + 1)}

    known = {n: set().union(*(grams(texts[i], n) for i in marks)) for n in language.LENGTHS}

    def kernel(a, b):
        sets = [(grams(a, n) & known[n], grams(b, n) & known[n]) for n in language.LENGTHS]
        return sum(len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for x, y in sets)

    k = np.array([[kernel(t, texts[m]) for m in marks] for t in texts])
    values, vectors = np.linalg.eigh(k[marks])
    z = k @ (vectors / np.sqrt(values))
    y = np.array([[1.0 if g == x else -1.0 for x in model.languages] for g in langs])
    # one-versus-rest ridge with an intercept that is not shrunk, each text weighing 1 / 12
    design = np.hstack([z, np.ones((len(z), 1))])
    pull = np.diag([1e-2 / 3] * z.shape[1] + [0.0])
    solved = np.linalg.solve(design.T @ design / 12 + pull, design.T @ y / 12)
    new = [*texts, "abc xyz", "dfg éé q"]
    want = np.hstack([np.array([[kernel(t, texts[m]) for m in marks] for t in new]) @ (vectors / np.sqrt(values)), np.ones((len(new), 1))]) @ solved
    assert np.allclose(model.margins(new), want, atol=1e-3)


def test_language_sample_is_bounded(spark):
    """Repeated rows, rows without an id and a crowd of languages draw no more than the bounds say."""
    rows = [(None, f"text {i % 7} one", "en") for i in range(400)] + [(i, f"mot {i}", "fr") for i in range(300)] + [(1, f"wort {i}", f"x{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_sample(docs, 5, 99, 20, 100, 10, 1000)
    counts = {g: sum(x == g for _, x in got) for g in {x for _, x in got}}
    assert counts == {"en": 7, "fr": 20} | {f"x{i:03}": 1 for i in range(8)} and len(set(got)) == len(got)
    assert got == language.training_sample(docs.repartition(7), 5, 99, 20, 100, 10, 1000)
    assert len(language.training_sample(docs, 5, 99, 20, 100, 10, 20)) <= 20


def test_quality_score_equals_densities():
    """Scores against Gaussian log densities with inverted covariances."""
    rng = np.random.default_rng(5)
    x = {k: rng.normal(k, 1 + k, (200 + 50 * k, quality.N_STATS)) @ rng.normal(size=(quality.N_STATS, quality.N_STATS)) for k in (0, 1)}
    model = quality.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    every = np.vstack([x[0], x[1]])
    centre, scale = every.mean(0), every.std(0)
    cov = {k: np.cov(v.T, bias=True) / np.outer(scale, scale) for k, v in x.items()}
    within = sum(len(v) * cov[k] for k, v in x.items()) / len(every)
    logs = []
    for k, v in x.items():
        mixed = 0.8 * cov[k] + 0.2 * within
        mixed = 0.9 * mixed + 0.1 * np.diag(np.diag(mixed)) + 1e-3 * np.eye(quality.N_STATS)
        off = (every - v.mean(0)) / scale
        logs.append(np.log((len(v) + 0.5) / (len(every) + 1)) - 0.5 * np.linalg.slogdet(mixed)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(mixed), off))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-6)


def test_quality_held_out(spark, docs, labels):
    found = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.95
    rank = found.score.rank()
    good = found.quality == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) >= 0.98


def test_quality_sums_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.N_STATS))
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "label int, stats array<double>").repartition(5)
    for k, (n, s, ss) in quality.class_sums(df).items():
        own = x[y == k]
        assert n == len(own) and np.allclose(s, own.sum(0)) and np.allclose(ss, own.T @ own)


def test_quality_edges(spark, labels):
    for known in (labels, labels.limit(0), spark.createDataFrame([(4, 1), (4, None), (5, 1), (None, 0)], "doc_id long, quality int")):
        got = quality.score_quality(frame(spark), known.select("doc_id", "quality")).collect()
        assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score_quality(frame(spark, []), labels).count() == 0


def brute_marginals(emit, move):
    """All paths of a short chain."""
    m, e = np.exp(move), np.exp(emit)
    total, toxic = 0.0, np.zeros(len(emit))
    for path in np.ndindex(*[2] * len(emit)):
        w = np.prod([x if s else 1.0 for s, x in zip(path, e)]) * np.prod([m[a, b] for a, b in zip(path, path[1:])])
        total += w
        toxic += w * np.array(path)
    return toxic / total


def test_marginals_equal_all_paths():
    """Documents of a batch are chains of their own; blocks of any number of tokens compose exactly."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 10, rng.integers(1, 60))
        move, emits = rng.normal(size=(2, 2)), [rng.normal(0, 3, n) for n in sizes]
        opens = np.concatenate([np.arange(n) == 0 for n in sizes])
        got = toxicity.marginals(np.concatenate(emits), opens, move)
        assert np.allclose(got, np.concatenate([brute_marginals(e, move) for e in emits]), atol=1e-9)


def test_long_chain_equals_step_by_step():
    rng = np.random.default_rng(4)
    emit, move = rng.normal(-2, 3, 30_000), rng.normal(size=(2, 2))
    m, e, a, forward = np.exp(move), np.exp(emit), np.array([1.0, 1.0]), []
    for t in range(len(e)):
        a = np.array([1.0, e[0]]) if t == 0 else (a @ m) * [1.0, e[t]]
        a = a / a.sum()
        forward.append(a[1] / a[0])
    assert np.allclose(toxicity.ratios(emit, np.arange(len(e)) == 0, move)[0], forward)


def test_gradient_of_the_likelihood():
    """One small step of the weights changes the log likelihood as the difference of counts says."""
    rng = np.random.default_rng(6)
    n, y = 7, rng.integers(0, 2, 7)
    emit, move = rng.normal(size=n), rng.normal(size=(2, 2))

    def likelihood(emit, move):
        w = {p: sum(x for s, x in zip(p, emit) if s) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in np.ndindex(*[2] * n)}
        return w[tuple(y)] - np.log(sum(np.exp(x) for x in w.values()))

    features, opens = np.arange(n)[None, :].astype(np.int32), np.arange(n) == 0
    weight, moved = toxicity.climb(features, n + 1, opens, y, np.append(emit, 0.0), move, 1, 0.0)
    numeric = [(likelihood(emit + 1e-6 * (np.arange(n) == i), move) - likelihood(emit, move)) / 1e-6 for i in range(n)]
    step = 0.5 * np.array(numeric) / np.sqrt(1e-2 + np.array(numeric) ** 2)
    assert np.allclose(weight[:-1] - emit, step, atol=1e-3)
    for a, b in np.ndindex(2, 2):
        more = move.copy()
        more[a, b] += 1e-6
        g = (likelihood(emit, more) - likelihood(emit, move)) / 1e-6
        assert moved[a, b] - move[a, b] == pytest.approx(0.5 * g / np.sqrt(1e-2 + g**2), abs=1e-3)


def score(model, *texts):
    return toxicity.score(model, model.table(), list(texts), Powers())


def test_toxic_spans():
    texts = [f"some a{i % 7} plain words of left{i} {'idiot' if i % 3 == 0 else 'nice'} b{i % 5} text" for i in range(150)]
    model = toxicity.fit(texts, [int("idiot" in t) for t in texts], [1.0] * len(texts))
    hard = ["Plain words, IDIOT! and more", "", "Größe İ 🙂 “idiot” 漢字 idiot", "plain words", " of left3 idiot b1"]
    scores, spans = score(model, *hard)
    assert [[t[a:b].lower() for a, b, _ in x] for t, x in zip(hard, spans)] == [["idiot"], [], ["idiot", "idiot"], [], ["idiot"]]
    assert scores[0] > 0.8 and scores[3] < 0.2 and scores[1] == pytest.approx(score(model, "")[0][0])
    assert [float(score(model, t)[0][0]) for t in hard] == pytest.approx(scores.tolist())


def test_beginnings():
    """A word never seen is toxic by its beginning."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [" ".join([*(word() for _ in range(8)), *([f"grumble{i % 40}", "person"] if i % 2 else [word(), "person"]), word()]) for i in range(300)]
    model = toxicity.fit(texts, [i % 2 for i in range(300)], [1.0] * 300)
    said = [f"{word()} grumblexx person {word()}", f"{word()} hhggff person {word()}"]
    scores, spans = score(model, *said)
    assert scores[0] > 0.5 > scores[1] and any("grumblexx" in said[0][a:b] for a, b, _ in spans[0]) and not spans[1]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.tag_toxicity(docs, labels.select("doc_id", "toxic")).drop("spans").join(labels, "doc_id").where("held_out").toPandas()
    clean, toxic = found[found.toxic == 0], found[found.toxic == 1]
    assert len(toxic) > 100 and clean.predicted.mean() <= 0.02 and toxic.predicted.mean() >= 0.9
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()


def test_sample_of_repeated_ids_is_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(500)] + [(None, "x")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, 4, 99, {0: 10, 1: 10}, 100)
    assert sorted(r.toxic for r in sample.collect()) == [0, 0, 0, 1, 1, 1]
    assert toxicity.training_sample(docs, labels.limit(0), 4, 99, {0: 10, 1: 10}, 100) is None


def test_fit_on_the_cluster_is_the_fit(spark):
    rows = [(i, f"some a{i % 7} plain words of left{i} {'idiot' if i % 3 == 0 else 'nice'} b{i % 5} text", int(i % 3 == 0), 1.0 + i % 2) for i in range(120)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int, weight double")
    got, want = toxicity.fitted(sample.repartition(5)), toxicity.fit([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    assert np.array_equal(got.table(), want.table()) and np.array_equal(got.move, want.move) and np.array_equal(got.logistic, want.logistic)
    assert np.array_equal(toxicity.fitted(sample.limit(0)).logistic, toxicity.fitted(None).logistic)


def test_toxicity_edges(spark, labels):
    for known in (labels, labels.limit(0)):
        got = toxicity.tag_toxicity(frame(spark), known.select("doc_id", "toxic")).collect()
        assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.tag_toxicity(frame(spark, []), labels).count() == 0


def test_all_of_the_sample_is_learned():
    """Toxic documents behind thousands of clean ones are learned, and the order of the sample does not matter."""
    clean = [(f"some a{i % 7} plain words of left{i % 50} nice b{i % 5} text", 0) for i in range(4100)]
    rows = clean + [(f"some a{i % 7} plain words of left{i} idiot b{i % 5} text", 1) for i in range(200)]
    one, other = (toxicity.fit([t for t, _ in r], [y for _, y in r], [1.0] * len(r)) for r in (rows, rows[::-1]))
    assert np.allclose(one.move, other.move, atol=1e-6) and np.allclose(one.table(), other.table(), atol=1e-4)
    text = "plain words, idiot and more"
    scores, spans = score(one, text)
    assert scores[0] > 0.8 and [text[a:b] for a, b, _ in spans[0]] == ["idiot"]
