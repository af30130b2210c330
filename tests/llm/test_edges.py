"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, and brute-force counterparts."""

import collections
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from beaconry.llm import common, decontam, forest, licenses, packing, quality, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


def hard_rows(seed=1):
    """Null ids and texts, an empty, a blank and a very long text, repeated rows, and one id on two texts."""
    rng = random.Random(seed)
    a, long_ = prose(rng, 80), prose(rng, 30_000)
    texts = [(1, a), (1, a), (2, None), (3, ""), (4, " \n\t"), (5, long_), (None, prose(rng, 50)), (None, None), (6, prose(rng, 60)), (6, prose(rng, 60)), (7, "漢字" * 4000), (8, "one"), *((20 + k, prose(rng, 50)) for k in range(20))]
    return [(i, t, "en", "s", len(t or "")) for i, t in texts]


@pytest.fixture(scope="module")
def hard(spark):
    """With columns named like outputs and internals of the operators."""
    names = ("score", "keep", "license", "tag", "blobs", "h", "pattern", "row", "length", "item_id", "_units", "predicted", "kind")
    return spark.createDataFrame(hard_rows(), SCHEMA).withColumns({c: F.lit(k) for k, c in enumerate(names)}).repartition(3)


def ids(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


WANT = sorted(-1 if i is None else i for i, *_ in hard_rows())


def test_every_row_gives_one_row(hard, spark):
    labels = spark.createDataFrame([(20 + k, k % 2) for k in range(20)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels)
    for out in (toxicity.score_toxicity(hard, model), quality.score_quality(hard), licenses.scan_licenses(hard), tokens.token_counts(hard, P.path("piece_bpe_32k.model"))):
        rows = out.collect()
        assert ids(rows) == WANT
        # repeated rows say the same
        a, b = [r for r in rows if r.doc_id == 1]
        assert a == b
    kept = quality.score_quality(hard, keep_text=True)
    assert set(hard.columns) - {"score", "keep"} <= set(kept.columns) and kept.count() == len(WANT)
    assert all(r.score == 0.0 and not r.keep for r in quality.score_quality(hard).collect() if r.doc_id in (2, 3, 4))


def test_leaks_of_hard_rows(hard, spark):
    rng = random.Random(9)
    item, long_ = prose(rng, 40), prose(rng, 20_000)
    more = spark.createDataFrame([(50, f"{long_} {item} {long_}"), (51, item), (51, item), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = hard.select("doc_id", "text", "tag", "item_id").unionByName(more.withColumns({"tag": F.lit(1), "item_id": F.lit(2)}))
    assert collections.Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()) == {(50, 1): 1, (51, 1): 2, (None, 1): 1}
    kept = decontam.drop_leaks(docs, bench)
    assert ids(kept.collect()) == WANT and kept.columns == docs.columns


def test_budgets_are_look_ups(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = [prose(rng, 60), "  two  spaces ▁ and naïve 漢字 \n\t x", "", None, "word"]
    t = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, limit=20, tables=True)
    for r in tokens.within_budget(t, F.lit(20)).collect():
        x = texts[r.doc_id] or ""
        assert [len(sp.encode(x[:e])) for e in r.ends] == list(r.counts) and r.ends[-1] == len(x)
        assert r.cut_tokens == max(n for n in r.counts if n <= 20) and len(sp.encode(x[: r.cut_chars])) == r.cut_tokens
        assert len(sp.encode(x[: r.fit_chars])) <= 20 and (r.fit_chars == len(x)) == (r.counts[-1] <= 20)


def test_pieces_against_the_library(hard, spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    extra = [(60, "a<|endoftext|>b  c\n\n d", "en", "s", 1), (61, "x" * 500 + "   ­é", "en", "s", 1)]
    docs = hard.select(*SCHEMA.replace(",", "").split()[::2]).unionByName(spark.createDataFrame(extra, SCHEMA))
    got = collections.defaultdict(list)
    for r in packing.pack_documents(docs, path, 128, ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for i, t, *_ in hard_rows() + extra:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(x) - 1) % 128 + 1
        cuts = [0, *range(first, len(x) + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i].append((k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_expectation_maximisation_against_plain_loop():
    rng = random.Random(3)
    n = len(quality.LABELLERS)
    patterns = np.array(sorted({sum(rng.choice([0, 1, 1, 2]) * 3**k for k in range(n)) for _ in range(60)} - {0}))
    counts = np.array([rng.randint(1, 40) for _ in patterns], float)
    post, _ = quality.expectation_maximisation(patterns, counts, rounds=30)
    v = [[int(p) // 3 ** (n - 1 - k) % 3 for k in range(n)] for p in patterns]
    member = []
    for row in v:
        bad = [x == 2 for x in row]
        member.append([0.97 * b / sum(bad) for b in bad] + [0.03] if any(bad) else [0.03 / n] * n + [0.97])
    for _ in range(30):
        old = member
        prior = [(sum(m[c] * w for m, w in zip(member, counts)) + 0.5) / (sum(counts) + 0.5 * (n + 1)) for c in range(n + 1)]
        rate = {}
        for c in range(n + 1):
            for k in range(n):
                good, bad = (sum(m[c] * w for m, w, row in zip(member, counts, v) if row[k] == x) + 0.5 for x in (1, 2))
                rate[c, k, 1], rate[c, k, 2] = good / (good + bad), bad / (good + bad)
        member = []
        for row in v:
            p = [prior[c] * np.prod([rate[c, k, x] for k, x in enumerate(row) if x]) for c in range(n + 1)]
            member.append([x / sum(p) for x in p])
        if max(abs(a - b) for m, o in zip(member, old) for a, b in zip(m, o)) < 1e-9:
            break
    assert post.tolist() == pytest.approx([m[n] for m in member], abs=1e-9)


def test_newton_with_conjugate_gradients_finds_the_optimum():
    rng = np.random.default_rng(1)
    rows = [(np.arange(12), rng.integers(1, 9, 12)) for _ in range(80)]
    target = rng.random(80)
    w, b = quality.train(rows, target, ridge=1e-3)
    x = np.array([n / n.sum() for _, n in rows])
    p = 1 / (1 + np.exp(-(x @ w[:12] + b)))
    # the gradient vanishes
    assert np.abs(x.T @ (p - target) + 1e-3 * 80 * w[:12]).max() < 1e-5 and abs((p - target).sum()) < 1e-4


def test_forest_recall_below_the_fitted_levels(spark, monkeypatch):
    """Leaves of some eight vectors, of which most levels have no thresholds of their own."""
    monkeypatch.setattr(forest, "FITTED", 3)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((500, 24))
    v = np.concatenate([c + s * rng.standard_normal((3, 24)) for c, s in zip(centres, rng.uniform(0.05, 0.3, 500))])
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(None, [1.0] * 24), (None, None), (9000, [2.0] * 24)], "vec_id long, embedding array<double>")
    got = {(-1 if r.vec_id is None else r.vec_id): r for r in forest.near_vectors(frame, leaf=8).filter("vec_id is not null or n_links > 0").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(v))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() > 500
    # rows without an id are one node, and it links
    assert got[9000].n_links == 1 and got[9000].component_id == -1


def test_forest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.near_vectors(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in forest.near_vectors(nulls).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_licences_of_hard_rows(spark):
    rng = random.Random(4)
    long_ = "\n".join(prose(rng, 12) for _ in range(1500))
    line = "Released under the MIT License."
    rows = [(None, line, "x"), (1, f"{long_}\n{line}\n{long_}", "y"), (2, line, "z"), (2, line, "z")]
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()]
    assert collections.Counter(got) == {(None, "mit"): 1, (1, "mit"): 1, (2, "mit"): 2}


def test_pipeline_stages_with_hard_rows(hard, spark):
    """Each stage against what its contract says of these rows, with columns of its own names passed over."""
    import corpus_pipeline as C

    keep = {r.doc_id for r in quality.score_quality(hard).filter("keep").collect()}
    good = C.quality_classifier(spark, hard, SF)
    assert good.columns == list(C.COLUMNS) and {r.doc_id for r in good.collect()} == keep and not keep & {2, 3, 4}
    once = C.minhash_near_dedup(spark, hard, SF).collect()
    # the repeated row goes; the two texts of one id, the rows without an id and those without words stay
    assert ids(once) == sorted(WANT[: WANT.index(1)] + WANT[WANT.index(1) + 1 :])
    cut = C.suffix_array_dedup(spark, hard, SF)
    assert cut.columns == list(C.COLUMNS) and ids(cut.collect()) == WANT
    left = {r.doc_id: r for r in cut.collect()}
    # equal rows are two places, and so is a text that repeats itself
    assert left[1].text == "" and len(left[7].text) < 4000 and left[5].text == dict((i, t) for i, t, *_ in hard_rows())[5]
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert ids(C.benchmark_decontamination(spark, hard, SF).collect()) == WANT
    assert {r.doc_id for r in C.best_fit_packing(spark, hard, SF).collect()} == {i for i, *_ in hard_rows()}


def test_pipeline_stages_with_empty_tables(spark):
    import corpus_pipeline as C

    none = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0, name


def test_pipeline_against_single_steps(spark):
    """run() is the stages after one another: near-duplicates, bytes and leaks by brute force over what is left."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    t = common.Tables(spark, "test")
    good = t.cut(C.quality_classifier(spark, docs, SF))
    rows = {r.doc_id: r.text for r in good.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, (x or "").encode().lower().split()) for i, x in rows.items())}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i for i in rows if find(i) == i}
    once = t.cut(C.minhash_near_dedup(spark, good, SF))
    assert {r.doc_id for r in once.collect()} == kept
    seen = collections.Counter(x[k : k + 200] for i in kept for x in [rows[i].encode()] for k in range(len(x) - 199))
    want = {}
    for i in kept:
        x = rows[i].encode()
        mask = np.ones(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                mask[k : k + 200] = False
        want[i] = bytes(np.frombuffer(x, np.uint8)[mask]).decode("utf8", "ignore")
    cut = t.cut(C.suffix_array_dedup(spark, once, SF))
    assert {r.doc_id: r.text for r in cut.collect()} == want
    index = decontam.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = {r.doc_id for r in C.benchmark_decontamination(spark, cut, SF).collect()}
    assert clean == {i for i, x in want.items() if not index.scan(x, 0.8)}
