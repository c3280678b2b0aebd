"""The stages of the pipeline, the opN queries' digests and the learned models against brute force, with nulls, repeats, odd names and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.llm import jaccard, pieces, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"
#: Names that the operators' own columns have.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int, n_auto string, component_id long, mix_tokens double, __row string, `a.b c` string, `__` string, ___ int"


def row(i, text, lang="en", source="s1", n=None):
    return (i, text, lang, source, n if n is not None else len(text or ""), True, 1, "x", 5, 0.5, None, "odd", "under", 3)


def sentences(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = sentences(1, 60), sentences(2, 80)
    key = "9f" * 20
    rows = [row(1, a), row(2, a), row(3, a + " more"), row(4, b, "de", None), row(5, None), row(6, ""), row(7, " \n\t"), row(None, sentences(3, 40)), row(None, sentences(3, 40))]
    rows += [row(8, f"{sentences(4, 30)} token = {key} {sentences(5, 9)}"), row(9, "x" * 200_000 + " " + sentences(6, 50)), row(10, b, None, "s2"), row(10, sentences(7, 30)), row(11, sentences(8, 25), "fr", "other")]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def labels_dir(tmp_path_factory, spark):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(frame):
    return sorted(frame.collect(), key=repr)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_quality_stage(spark, docs, labels_dir):
    got = P.quality(spark, docs, labels_dir)
    assert got.columns == docs.columns
    fails = lambda w: len(w) < 10 or 100 * len({j + k for j in range(len(w) - 4) for k in range(5) if any(w[j : j + 5] == w[i : i + 5] for i in range(len(w) - 4) if i != j)}) > 20 * len(w)
    assert rows_of(got) == sorted((r for r in docs.collect() if not fails(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), key=repr)


def test_near_duplicates_stage(spark, docs, labels_dir):
    got = P.near_duplicates(spark, docs, labels_dir)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id or -1) for r in got.collect())
    # 2 and 3 are tied to 1; 10 has the text of 4 on one of its rows, so it goes as a whole; null ids stay
    assert ids == [-1, -1, 1, 4, 5, 6, 7, 8, 9, 11]
    twice = docs.where("doc_id IN (9, 11)").unionByName(docs.where("doc_id IN (9, 11)").withColumn("text", F.concat(F.reverse("text"), F.lit(" z"))))
    once = P.near_duplicates(spark, twice, labels_dir).collect()
    assert sorted(r.doc_id for r in once) == [9, 11] and sorted(map(repr, once)) == sorted(map(repr, P.near_duplicates(spark, twice.repartition(7), labels_dir).collect()))


def test_no_secrets_stage(spark, docs, labels_dir):
    got = P.no_secrets(spark, docs, labels_dir)
    assert got.columns == docs.columns
    for a, b in zip(rows_of(docs), rows_of(got), strict=True):
        if a.doc_id == 8:
            assert "9f9f" not in b.text and P.REDACTED in b.text and b.n_chars == len(b.text)
        else:
            assert a == b


def test_mixture_stage(spark, docs, labels_dir):
    got = P.mixture(spark, docs, labels_dir)
    assert got.columns == docs.columns
    every = [repr(r) for r in docs.collect()]
    assert all(repr(r) in every for r in got.collect())
    assert rows_of(got) == rows_of(P.mixture(spark, docs.repartition(7), labels_dir))
    taken = sum(len((r.text or "").split()) for r in got.collect())
    assert 0 < taken <= 0.8 * sum(len((r.text or "").split()) for r in docs.collect()) + 1e-6


def test_encoding_stage(spark, docs, labels_dir):
    got = P.encoding(spark, docs, labels_dir).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())


def test_stages_take_an_empty_table(spark, docs, labels_dir):
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("1 = 0"), labels_dir).count() == 0


def test_run_is_the_stages_in_order(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        now = stage(spark, now, SF)
        if name != "encoding":
            now = spark.createDataFrame(now.collect(), now.schema)
    assert rows_of(P.run(spark, SF)) == rows_of(now)


def test_ids_of_other_types(spark, docs):
    want = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs.where("doc_id < 10")).collect()}
    for kind in ("int", "string"):
        got = jaccard.join(docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert {int(r.doc_id): (r.n_shingles, int(r.component_id)) for r in got.collect()} == want


def test_quality_stage_takes_text_ids(spark, docs, tmp_path):
    spark.createDataFrame([("x1", 1, 0), ("x4", 0, 0), ("77", 1, 0)], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    named = docs.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id")))
    got = P.quality(spark, named, str(tmp_path))
    assert got.columns == named.columns and {r.doc_id for r in got.collect()} <= {r.doc_id for r in named.collect()}


def test_piece_counts(spark, docs):
    """Every word's greedy pieces, cut one by one from a set of all pieces."""
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    import base64

    vocabulary = {base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()}
    longest = max(map(len, vocabulary))

    def cut(w):
        n = 0
        while w:
            k = next((k for k in range(min(longest, len(w)), 0, -1) if w[:k] in vocabulary), 0)
            if not k:
                return 1
            w, n = w[k:], n + 1
        return n

    some = docs.where("doc_id IS NULL OR doc_id <> 9").collect()
    long = {9: "ab" * 300 + " " + "é日" * 40}
    frame = spark.createDataFrame([(r.doc_id, r.text, 1) for r in some] + [(9, long[9], 1)], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_pieces, r.longest) for r in pieces.piece_counts(frame, path).collect())
    each = [(r.doc_id, [cut(b" " + w.encode()) for w in words(r.text)]) for r in frame.collect()]
    assert got == sorted((i or -1, len(n), sum(n), max(n, default=0)) for i, n in each)
    assert pieces.piece_counts(frame.where("1 = 0"), path).count() == 0


def test_formats_have_the_shape_of_their_tokens():
    rng = random.Random(5)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    chain = secrets.infer([token(40) for _ in range(100)])
    assert len(chain.moves) == 41  # a state for each place: none of them may end early
    dashed = secrets.infer([f"{token(8)}-{token(4)}" for _ in range(200)])
    assert dashed.score(f"{token(8)}-{token(4)}") > dashed.score(token(8)[:8] + "-" + token(4)[:2])
    assert dashed.score(token(13)) == -np.inf
    loop = secrets.infer(["a" * n for n in (np.random.default_rng(0).geometric(0.2, 3000)).tolist()])
    assert len(loop.moves) < 8  # lengths without a memory fold into a loop
    for f in (chain, dashed, loop):
        for moves, end in zip(f.moves, f.ends, strict=True):
            assert sum(np.exp(m[1]) for m in moves.values()) + np.exp(end) == pytest.approx(1, abs=1e-9)
        for moves in f.moves:
            for c, (_, _, seen, other) in moves.items():
                assert sum(np.exp(p) for p in seen.values()) + (secrets.SIZES.get(c, 1) - len(seen)) * np.exp(other) == pytest.approx(1)


def test_every_candidate_is_scored(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
    rows = [(i, f"password: {key(32)} and ordinarylongword{i % 7} é") for i in range(80)] + [(90, f"see {key(32)} twice {key(32)}"), (91, f"é {key(32)}"), (92, "anotherordinaryword and 2024-01-01-2024"), (None, None), (93, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    formats = secrets.learn(frame)
    got = {r.doc_id: r for r in secrets.spans(frame, formats).collect()}
    for i, t in rows:
        found = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", t or "")]
        likely = [(a, b) for a, b in found if secrets.gain(formats, t[a:b]) >= secrets.MARGIN]
        fixed = [tuple(map(int, s.split(":")[1:])) for s in filter(None, got[i].base_spans.split(","))]
        assert (got[i].n_scored, got[i].n_likely) == (len(found), len(likely))
        assert got[i].n_auto == sum(not any(x < b and a < y for x, y in fixed) for a, b in likely)
    assert (got[90].n_auto, got[91].spans, got[92].n_auto) == (2, "auto:2:34", 0)


def made(rule, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    doc, term, label = [], [], []
    for i in range(n):
        a, b = rng.random(2) < 0.5
        label.append(float(rule(a, b)))
        mine = sorted({1} if a else set()) + ([2] if b else []) + rng.integers(100, 400, 10).tolist()
        doc += [i] * len(mine)
        term += mine
    both = np.unique(np.array(doc) * (1 << 20) + np.array(term))
    return both >> 20, both & ((1 << 20) - 1), np.array(label)


@pytest.mark.parametrize("rule, alone", [(lambda a, b: a != b, 0.65), (lambda a, b: a == b, 0.65)])
def test_toxicity_learns_what_weights_alone_cannot(rule, alone):
    doc, term, label = made(rule)
    train = doc < 2000
    right = lambda m, pairs: ((m.margin(doc[~train] - 2000, term[~train], 1000, pairs) > 0) == label[2000:]).mean()
    machine = toxicity.fit(doc[train], term[train], label[:2000])
    assert right(machine, True) > 0.97
    assert right(toxicity.fit(doc[train], term[train], label[:2000], factors=0), False) < alone


def test_toxicity_margin(spark):
    """Scores against the formula, pair by pair."""
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(0.3, rng.normal(size=1 << toxicity.BITS).astype(np.float32), rng.normal(size=(1 << toxicity.BITS, 3)).astype(np.float32))
    texts = ["One two three two", "", None, "é-x 日本 one", "solo", "x" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(None, "One two three two")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, machine).collect()}
    import pyarrow as pa

    for i, t in enumerate(texts):
        _, term = toxicity.terms(pa.array([t], pa.string()))
        pairs = sum(float(machine.factors[a] @ machine.factors[b]) for a, b in itertools.combinations(term.tolist(), 2))
        z = 0.3 + machine.weights[term].sum() + pairs / np.sqrt(max(len(term), 1))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5) and got[i].n_terms == len(term)
    assert got[None].score == got[0].score


def test_held_out_toxicity(spark):
    """Trained without the held-out rows, the query's scores order them by their labels."""
    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, at).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean(np.subtract.outer(bad, good) > 0) > 0.95
    assert sum(s >= 0.5 for s in good) <= 0.01 * len(good) and sum(s >= 0.5 for s in bad) >= 0.7 * len(bad)


def test_quality_verdict_after_training(spark):
    """The verdict is the share of words in lines that the best path over a text's lines calls content."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    for r, t in zip(quality.quality(docs, model).orderBy("doc_id").collect(), [x.text for x in docs.orderBy("doc_id").collect()], strict=True):
        x = quality.scan(pa.array([t], pa.string()))
        unary = model.weights[x["bins"]].sum(1)
        if 0 < len(unary) <= 12:
            paths = itertools.product((0, 1), repeat=len(unary))
            best = max(paths, key=lambda y: model.start[y[0]] + sum(unary[i, v] for i, v in enumerate(y)) + sum(model.step[a, b] for a, b in zip(y, y[1:], strict=False)))  # noqa: B023
            share = (x["line_words"] * np.array(best)).sum() / max(r.n_words, 1)
            assert r.content_share == pytest.approx(share)
        assert r.kept == (not r.base_failed and r.content_share >= quality.KEEP_SHARE)


def test_epochs_have_orders_of_their_own(spark):
    from tallyspark.llm import mixing

    rows = spark.createDataFrame([(i, "w w w w") for i in range(400)], "doc_id long, text string")
    one = {"all": F.lit("x")}
    first = {r.doc_id for r in mixing.mix(rows, one, {"all": F.lit(1)}, budget=400, epochs=3).collect()}
    second = {r.doc_id for r in mixing.mix(rows, one, {"all": F.lit(1)}, budget=2000, epochs=3).where("mix_copies = 2").collect()}
    assert len(first) == len(second) == 100 and len(first & second) < 60
