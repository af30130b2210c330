"""Every operator on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from beaconry.llm import common, debruijn, decontam, forest, licenses, links, minhash, packing, quality, suffix, tokens, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = prose(60), prose(150)
    rows = [(k, prose(rng.randint(1, 200))) for k in range(60)]
    rows += [(60 + k, f"{prose(40)}\n{shared} {prose(30)}") for k in range(8)]
    for k in range(12):
        w = base.split()
        w[rng.randrange(150)] = "edit"
        rows.append((70 + k, " ".join(w[: 150 - k % 3])))
    rows += [(90, None), (91, ""), (92, " \n "), (93, "one"), (94, "ab " * 400), (95, "x" * 900), (96, base), (97, base), (98, "two words"), (99, "two words"), (None, prose(30)), (100, prose(9000))]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(corpus(), SCHEMA)
    # columns named like outputs and internals
    return extra.withColumns({"score": F.lit("x"), "tag": F.lit(1), "blobs": F.lit(2), "kind": F.lit(3), "length": F.lit(4)}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows=None):
    return [(-1 if i is None else i, t or "") for i, t, *_ in (rows or corpus())]


def by_id(frame, *cols):
    return {(-1 if r.doc_id is None else r.doc_id): tuple(r[c] for c in cols) for r in frame.collect()}


@pytest.mark.parametrize("heavy", [debruijn.HEAVY, 300])
def test_debruijn(docs, empty, heavy):
    seen, want = set(), {}
    for i, t in sorted(texts()):
        w = t.encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                keep[k : k + 20] = [False] * 20
            seen.add(key)
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        want[i] = (len(w), keep.count(False), hashlib.sha256(kept).hexdigest())
    assert by_id(debruijn.remove_repeats(docs, heavy=heavy), "n_words", "n_removed", "kept_sha256") == want
    assert debruijn.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("split, heavy, bound", [(4096, suffix.HEAVY, suffix.SHARD), (2, 300, 1000)])
def test_suffix(docs, empty, split, heavy, bound):
    n = collections.Counter()
    for _, t in texts():
        b = t.encode()
        n.update(b[k : k + 200] for k in range(len(b) - 199))
    want = {}
    for i, t in texts():
        b = t.encode()
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                keep[k : k + 200] = False
        runs = int((~keep & np.concatenate([[True], keep[:-1]])).sum()) if len(b) else 0
        want[i] = (len(b), int((~keep).sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[keep])).hexdigest())
    assert by_id(suffix.remove_repeats(docs, split=split, heavy=heavy, bound=bound), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_array_and_kasai():
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    sa = suffix.suffix_array(text, ends)
    suffixes = []
    for p, e in zip(pieces, ends):
        suffixes += [(p[k:], e - len(p) + k) for k in range(len(p))]
    assert sa.tolist() == [at for _, at in sorted(suffixes)]
    of = {at: s for s, at in suffixes}
    lcp = suffix.common_prefixes(text, ends, sa)
    for a, b, n in zip(sa, sa[1:], lcp[1:]):
        x, y = of[a], of[b]
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_minhash(docs, empty):
    sets = {}
    for i, t in texts():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = brute_components(pairs, ids)
    assert pairs
    want = {i: (len(sets[i]), root[i], root[i] == i) for i in ids}
    assert by_id(minhash.near_duplicates(docs, 85), "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_long_lists(spark):
    """A group beyond the short lists' bound, and a passage that unlike texts share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(100)], " ".join(word() for _ in range(60))
    rows = []
    for k in range(150):
        w = list(base)
        w[k % 97] = word()
        rows.append((k, " ".join(w)))
    rows += [(200 + k, passage + " " + " ".join(word() for _ in range(30))) for k in range(120)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert {got[k] for k in range(150)} == {0} and all(got[200 + k] == 200 + k for k in range(120))


@pytest.fixture
def written(spark, monkeypatch):
    """Rows of each table that an operator writes, by its columns."""
    out, cut = [], common.Tables.cut

    def noted(self, df, *by):
        made = cut(self, df, *by)
        out.append((made.columns, made.count()))
        return made

    monkeypatch.setattr(common.Tables, "cut", noted)
    return out


def test_minhash_graded_copies(spark, written):
    """Copies with few to many edits, and texts with a passage of theirs: exact classes from few list entries and pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for k in range(300):
        w = list(base)
        for _ in range(k % 16):
            w[rng.randrange(150)] = word()
        rows.append((k, " ".join(w)))
    rows += [(300 + k, " ".join([*base[:60], *(word() for _ in range(90))])) for k in range(100)]
    # beyond the sketch, and some within it that link with larger ones
    long_ = [word() for _ in range(1040)]
    for k in range(80):
        w = long_[: 1020 + k % 4 * 6]
        for _ in range(k // 2):
            w[rng.randrange(1000)] = word()
        rows.append((400 + k, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(pairs, ids)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == {i: root[i] for i in ids} and 100 < sum(root[i] != i for i in ids) < 380
    # a class of the copies is listed under no more than its prefix, a class beyond the sketch under its runs
    assert sum(n for columns, n in written if columns == ["key", "doc", "n"]) <= 320 * 31 + 80 * (210 + 2 * minhash.RUNS)


def test_minhash_leaves_two_tables(spark, docs):
    import glob
    import os

    near = minhash.near_duplicates(docs, 85)
    root = max(glob.glob(f"{common.shared_dir(spark).removeprefix('file://')}/minhash-*"), key=os.path.getmtime)
    assert len(glob.glob(f"{root}/*")) == 2 and near.count() == len(corpus())


def test_near_dedup_moves_the_rows_that_go(spark, docs, written):
    import corpus_pipeline as C

    left = C.minhash_near_dedup(spark, docs, "").count()
    assert [n for columns, n in written if columns == ["row"]] == [len(corpus()) - left] and left < len(corpus())


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(500, 501 + k) for k in range(50)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.root for r in links.components(frame, common.Tables(spark, "test")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = brute_components([p for p in pairs], {x for p in pairs for x in p})
    assert got == {n: want[n] for n in nodes}


def test_forest(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    v = [(c + 0.25 * rng.standard_normal(16)).tolist() for c in centres for _ in range(6)] + [[0.0] * 16, None, [], [float("nan")] * 16, [None] * 16]
    v += [v[0], v[0], (np.array(v[1]) * 3).tolist(), [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, x, 0, "x") for k, x in enumerate(v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, leaf string"), leaf=32).collect()}
    ok = lambda x: bool(x) and None not in x and np.isfinite(x).all() and any(x)
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) if len(x) == len(y) else 0
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if ok(v[i]) and ok(v[j]) and cos(v[i], v[j]) >= 0.9]
    n = collections.Counter(x for p in pairs for x in p)
    root = brute_components(pairs, range(len(v)))
    right = sum(got[k] == (n[k], root[k], root[k] == k) for k in range(len(v)))
    assert right >= 0.97 * len(v) and all(got[k][0] <= n[k] for k in got)


def test_decontamination(spark, docs, empty):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (5, item + " tail")], "item_id long, text string")
    half = " ".join(item.split()[:15])
    more = spark.createDataFrame([(1, f"before {item} after"), (2, half), (3, None), (4, item.upper().replace(" ", ", ")), (5, "so TOO-short a text"), (6, "nothing"), (None, item)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(more, bench).collect()}
    assert got == {(1, 1), (1, 5), (4, 1), (4, 5), (5, 2), (None, 1), (None, 5)}
    assert decontam.find_leaks(empty, bench).count() == 0 == decontam.find_leaks(docs, bench.limit(0)).count()


def windows(text, item, size=5):
    """Similarity of each window of the item's length."""
    shingles = lambda w, m: [tuple(w[k : k + m]) for k in range(len(w) - m + 1)]
    w, x = decontam.WORD.findall(text.lower()), decontam.WORD.findall(item.lower())
    m = min(size, len(x))
    want, out = collections.Counter(shingles(x, m)), []
    for s in range(max(1, len(w) - len(x) + 1)):
        mine = collections.Counter(shingles(w[s : s + len(x)], m))
        out.append((mine & want).total() / ((mine | want).total()))
    return out


def test_decontamination_compares_all_windows():
    rng = random.Random(8)
    w = [f"w{k}" for k in range(50)]
    tail = lambda x: " ".join(f"v{k}" for k in range(400)) + f" {x}" * 40
    items = [" ".join(w), tail("no"), "a b a b a b a b a b a b", "a b c", "a"] + [" ".join(rng.choices("abc", weights=(6, 2, 1), k=n)) for n in (4, 6, 12, 25, 40)]
    docs = ["x y z " + " ".join(w[25:] + w[:25]) + " z y x", "so " + tail("yes") + " so", "", "a b", " ".join(w[:47])]
    docs += [" ".join(rng.choices("abcd", weights=(6, 2, 1, 1), k=n)) for n in range(1, 120)]
    index = decontam.Index(list(enumerate(items)))
    for d in docs:
        want = {k: max(s) for k, x in enumerate(items) for s in [windows(d, x)] if max(s) >= 0.8}
        got = index.scan(d, 0.8)
        assert {k: x for k, _, x in got} == pytest.approx(want)
        assert all(s == windows(d, items[k]).index(max(windows(d, items[k]))) for k, s, _ in got)
    assert [k for k, _, _ in index.scan(docs[0], 0.8)][:1] == [0] and index.scan(docs[1], 0.8)[0][0] == 1


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    index = decontam.Index([(k, " ".join(f"t{k}x{j}" for j in range(20))) for k in range(50)])
    for _ in range(200):
        k = rng.integers(50)
        bits = np.unpackbits(index.prints[k])
        bits[rng.choice(128, decontam.RADIUS, replace=False)] ^= 1
        assert k in index.within(np.packbits(bits))


def test_token_counts(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in texts()}
    assert by_id(tokens.token_counts(docs, path), "n_bytes", "n_tokens", "over_limit") == want
    c = tokens.counter(path)
    for t in ("Hello  world, ▁mark\nnew <s> line", " lead", "naïve 漢字\t", "a", ""):
        assert c.prefix_counts(t).tolist() == [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
    assert tokens.token_counts(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 512, ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN).collect()
    total = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts())
    assert sum(r.length for r in rows) == total
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 512
    # no more than best-fit decreasing, run plainly over all pieces, needs
    rooms = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 512) - n)
    assert len(bins) == len(rooms)
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_plan_against_plain_best_fit():
    rng = random.Random(7)
    for _ in range(20):
        cap = rng.choice([20, 64])
        lengths = [rng.randint(1, cap) for _ in range(200)]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(cap - n)
        plan = packing.best_fit_plan(dict(collections.Counter(lengths)), cap)
        assert len({b + k for _, _, b, n, _ in plan.tolist() for k in range(n)}) == len(rooms)


def test_licences(spark, empty):
    line = "Released under the MIT License."
    rows = [(1, line), (2, f"text\n{line.upper()}\nmore"), (3, None), (4, ""), (5, "the license of this"), (6, line + " " + "and much more " * 20)]
    # the second text matches by a line and, at 2 * 4 / (4 + 6), as a whole
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1), 2: ("mit", 2), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 0)}
    assert licenses.scan_licenses(empty).count() == 0


def test_wrapped_licences(spark):
    import textwrap

    prose = "\n".join(f"line {k} of prose that says nothing of note" for k in range(30))
    wrap = lambda name, mark="": textwrap.fill(licenses.TEMPLATES[name][-1], 60, initial_indent=mark, subsequent_indent=mark)
    rows = [(k, f"{prose}\n\n{wrap(n, m)}\n\n{prose}") for k, (n, m) in enumerate([("mit", ""), ("isc", "# "), ("gpl-3.0", " * "), ("apache-2.0", "// ")])]
    rows += [(4, f"{wrap('mit')}\n{prose}\n{wrap('isc')}\n{prose}\nReleased under the MIT\nLicense."), (5, wrap("mit").replace("\n", "\n\n")), (6, prose + "\nReleased under the MIT License.\n" + prose), (7, wrap("mit")[:150] + "\n" + prose)]
    got = {r.doc_id: (r.license, round(r.dice, 6), r.n_units, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the first line of the last is a notice by itself
    assert [got[k] for k in range(4)] == [("mit", 1.0, 1, "mit"), ("isc", 1.0, 1, "isc"), ("gpl-3.0", 1.0, 1, "gpl-3.0"), ("apache-2.0", 1.0, 2, "apache-2.0")]
    # "Released under the MIT" matches as a line too
    assert got[4] == ("isc", 1.0, 4, "isc,mit") and got[5] == got[6] == ("mit", 1.0, 1, "mit") and got[7] == (None, 0.0, 0, "")


def test_toxicity(spark, empty):
    assert toxicity.fold("1d10t m0r​on іdiot 2024") == " idiot moron idiot 2024 "
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(40)] + (["scum", "slur" + rng.choice("abc")] if bad else [])
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "you $cum")], "doc_id long, text string")
    m = toxicity.fit(d, spark.createDataFrame(labels[:300] + [(None, 1), (5, None)], "doc_id long, toxic int"))
    assert " scum " in m.lexicon and " slur" in m.lexicon
    got = by_id(toxicity.score_toxicity(d, m), "predicted")
    assert all(got[k] == (int(k % 4 == 0),) for k in range(400)) and got[900] == got[901] == (0,) and got[902] == (1,)
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    m.exceptions, m.automaton = ("pond scum",), None
    assert m.features("pond scum")[0] == 0 < m.features("scum")[0]


def test_toxicity_learns_exceptions(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = [(k, " ".join([*prose(20), *(["pond", "scum"] if k % 40 == 1 else ["filthy", "scum"] if k % 4 == 0 else []), *prose(20)]), int(k % 4 == 0)) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    assert "pond scum" in m.exceptions and "filthy scum" not in m.exceptions
    got = by_id(toxicity.score_toxicity(frame, m), "predicted")
    assert all(got[k] == (y,) for k, _, y in rows)


def test_matcher_against_plain_search():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
    for _ in range(50):
        lexicon = {f" {word()}" + " " * rng.randint(0, 1): 1.0 for _ in range(8)}
        free = tuple(f"{word()} {word()}" for _ in range(3))
        text = " " + " ".join(word() for _ in range(60)) + " "
        spans = [(k, k + len(x) + 1) for x in free for k in range(len(text)) if text.startswith(f" {x} ", k)]
        want = sorted((k + len(x) - 1, x) for x in lexicon for k in range(len(text)) if text.startswith(x, k) and not any(a <= k and k + len(x) - 1 <= b for a, b in spans))
        assert sorted(toxicity.Model(lexicon, exceptions=free).matches(text)) == want


def test_quality(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.score_quality(d).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.995 * len(good) and sum(r.keep for r in bad) <= 0.1 * len(bad)
    assert quality.score_quality(empty).count() == 0
    got = by_id(quality.score_quality(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")), "keep")
    assert got == {1: (False,), 2: (False,)}


def test_quality_reads_long_words_whole():
    head = "漢字" * 100
    plain, junk = (quality.Text(head + tail) for tail in ("漢字" * 300, "#$%1" * 150))
    assert len(plain.features) == len(junk.features) == 4 and plain.n == junk.n == 1
    assert (plain.features != junk.features)[1:].all() and plain.features[0] == junk.features[0]
    # pieces are marked as repeated like words; short words are as before
    assert (plain.features % 2).tolist() == [0, 1, 1, 1] and (quality.Text("a a b").features % 2).tolist() == [0, 1, 0]
    s = quality.Scorer(np.where(np.isin(np.arange(2 * quality.BUCKETS), junk.features[1:]), -9.0, 9.0), 0.0, {}, {})
    assert s.score(plain) > 0.9 > 0.1 > s.score(junk)


def test_quality_sample_is_fixed_and_without_copies(spark, monkeypatch):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40)) + "."
    bad = lambda: " ".join("".join(rng.choice("#$%1") for _ in range(5)) for _ in range(40))
    given = [good() for _ in range(150)] + [bad() for _ in range(50)]
    given += [given[0]] * 400 + [given[1] + " word" * 5000, None, "", "  "]
    taken = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda rows, *a: taken.append(rows) or train(rows, *a))
    docs = spark.createDataFrame([(t,) for t in given], "text string")
    fits = [quality.fit(docs.repartition(n), sample) for sample in (1000, 50) for n in (1, 7)]
    # each distinct text once, and all its words
    assert [len(x) for x in taken] == [201, 201, 50, 50] and max(n.sum() for _, n in taken[0]) == 5040
    for a, b in (fits[:2], fits[2:]):
        assert (a.weights == b.weights).all() and a.bias == b.bias


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == list(C.COLUMNS), name
        docs = common.Tables(spark, "test").cut(out)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] >= sizes[3] > 0
    assert C.run(spark, sf).select("doc_id").distinct().count() == sizes[3]


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as C

    sf, rng = "/root/testdata/sf0.001", random.Random(11)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    near = " ".join(["edit", *b.split()[1:]])
    # repeated rows, a near copy without an id, one id on unlike texts, rows without an id
    given = [(1, a), (1, a), (7, b), (None, near), (4, near), (5, c), (5, d), (None, e), (None, e), (6, f"{d} {item}"), (None, f"{c} {item}"), (6, prose())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], SCHEMA).repartition(3)
    rows = lambda x: sorted(((r.doc_id, r.text) for r in x.collect()), key=str)
    once = C.minhash_near_dedup(spark, docs, sf)
    kept = [(1, a), (4, near), (5, c), (5, d), (None, e), *given[9:]]
    assert rows(once) == sorted(kept, key=str) and once.columns == list(C.COLUMNS)
    # a text that stood twice as a row loses nothing
    cut = rows(C.suffix_array_dedup(spark, common.Tables(spark, "test").cut(once), sf))
    assert {(1, a), (4, near), (None, e)} <= set(cut) and len(cut) == len(kept)
    clean = C.benchmark_decontamination(spark, once, sf)
    assert rows(clean) == sorted([*kept[:5], given[-1]], key=str) and clean.columns == list(C.COLUMNS)
