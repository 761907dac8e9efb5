"""Operators of ``ledgerfold.llm`` against brute force, round trips and edge
cases: nulls in any column, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import base64
import hashlib
import math
import random
import re
import resource
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import ann, bpe, chains, chat, decontaminate, minhash, ngram_lm, quality, suffixes, warc
from ledgerfold.llm.common import SortedArrays, id_remainder, shard_of, workspace

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, uid long, label string, _text string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(1, 8))) for _ in range(400)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def changed(text, every):
    return " ".join("zz" + w if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


@pytest.fixture(scope="module")
def rows():
    base, passage = [prose(RNG.randint(60, 200)) for _ in range(40)], prose(70)
    texts = [*base, base[0], base[1], changed(base[2], 30), changed(base[3], 12), changed(base[3], 14), None, "", " \t\n", "One", "one", "a a a a " * 60, "a a a a " * 55,
             f"{prose(30)} {passage} {prose(20)}", f"{prose(10)} {passage.upper()}", f"{changed(passage, 25)} {prose(40)}", prose(20000)]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, base[5]), (None, None), (7, base[6])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 1.0, 3, "x", "y") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_lm_matches_direct_computation(spark, docs, rows):
    held = id_remainder("doc_id", 7) == 2
    got = ngram_lm.lm_scores(docs, held).collect()
    assert len(got) == len(rows)
    split = {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
    train = [[*words(t), "</s>"] for i, t in rows if not split[i]]
    one = Counter(w for t in train for w in t)
    total, size = sum(one.values()), len(one)
    two = Counter(p for t in train for p in zip(["<s>", *t], t))
    low = Counter(b for _, b in two)

    def discounts(counter):
        t = [sum(1 for v in counter.values() if v == c) for c in (1, 2, 3, 4)]
        return (0, *ngram_lm._discounts(t))

    d2, d1 = discounts(two), discounts(low)
    after = {}
    for (a, _), n in two.items():
        after.setdefault(a, []).append(n)

    def p(a, b):
        n = sum(low.values())
        out = max(low[b] - d1[min(low[b], 3)], 0) / n + sum(d1[min(v, 3)] for v in low.values()) / n / (size + 1)
        if a in after:
            n, c = sum(after[a]), two[a, b]
            out = (c - d2[min(c, 3)]) / n + sum(d2[min(v, 3)] for v in after[a]) / n * out
        return out

    expected = Counter()
    for i, t in rows:
        tokens = [*words(t), "</s>"]
        if len(tokens) > 5000:
            continue
        base = sum(math.log10((one[w] + 1) / (total + size + 1)) for w in tokens)
        full = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *tokens], tokens))
        expected[i, split[i], len(tokens), sum(w in one for w in tokens), total, round(base, 6), round(full, 6)] += 1
    assert expected == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got if r.n_tokens <= 5000)
    # each context's probabilities over vocabulary and unknown word sum to 1
    assert abs(sum(p("a", w) for w in one) + p("a", "never seen") - 1) < 1e-9


def test_lm_orders_and_empty(spark, docs, empty):
    model = ngram_lm.train(docs, order=3)
    assert sorted(model.levels) == [1, 2, 3]
    assert all(r.score < 0 for r in ngram_lm.score(model, docs, ["doc_id"]).collect())
    assert ngram_lm.lm_scores(empty, F.lit(False)).count() == 0
    assert {r.score for r in ngram_lm.lm_scores(docs, F.lit(True)).collect()} == {0.0}


def components(rows, k, percent):
    sets = [frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        low = min(known) if known and sets[i] else d
        out.append((d, len(sets[i]), low, d == low))
    return Counter(out)


def test_arrays_of_many_shards_need_few_files(tmp_path):
    """The shards of a task are one file, and files do not stay open."""
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 40000).astype(np.uint64) << np.uint64(1))
    times = (keys % np.uint64(1000)).astype(np.int64)
    shards, layout = shard_of(keys, 11), {}
    for task in range(400):
        own = shards % 400 == task
        layout |= {shard: tuple(row) for shard, *row in SortedArrays.write(str(tmp_path), 11, keys[own][::-1], [times[own][::-1], -(shards[own][::-1] > 5).astype(np.int64) + 1])}
    assert len(layout) == 2048 and len(list(tmp_path.iterdir())) == 400
    arrays, absent = SortedArrays(str(tmp_path), 11, layout), np.arange(5, 1 << 62, 1 << 50, dtype=np.uint64)
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(list(Path("/proc/self/fd").iterdir())) + 50, hard))
    try:
        asked = np.sort(np.concatenate([keys, absent]))
        position, (found, low) = arrays.find(asked, 2)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    here = np.isin(asked, keys)
    assert (position[~here] == -1).all() and sorted(position[here]) == list(range(arrays.size)) and arrays.size == len(keys)
    assert (found[here] == times).all() and (low[here] == (shards <= 5)).all() and not found[~here].any()
    assert arrays.find(keys[:0], 1)[0].shape == (0,)


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_components(docs, rows, k):
    assert Counter(map(tuple, minhash.near_duplicates(docs, k=k).collect())) == components(rows, k, 80)


def test_minhash_links_missed_by_hubs(spark, monkeypatch):
    """A family around 0.8: many members link with each other but not with the
    hub, in blocks of two."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base = prose(100).split(" ")
    rows = []
    for i in range(60):
        own = list(base)
        for at in RNG.sample(range(100), 7):
            own[at] = f"x{RNG.randint(0, 9999)}"
        rows.append((i, " ".join(own)))
    got = minhash.near_duplicates(frame(spark, rows), k=2)
    assert Counter(map(tuple, got.collect())) == components(rows, 2, 80)


def test_minhash_empty_and_dedup(docs, empty, rows):
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicated(empty).count() == 0
    kept = minhash.deduplicated(docs, k=5)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(set(left)) and all(n == 1 or not words(t) for (_, t), n in Counter(left).items())
    assert set(components(left, 5, 80).values()) == {1}


def test_suffixes_match_brute_force(spark, docs, rows, empty, monkeypatch):
    def brute(rows, length):
        raw = [(t or "").encode() for _, t in rows]
        seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
        out = []
        for (d, _), b in zip(rows, raw):
            cover = np.zeros(len(b), bool)
            for i in range(len(b) - length + 1):
                if seen[b[i:i + length]] > 1:
                    cover[i:i + length] = True
            kept = bytes(np.frombuffer(b, np.uint8)[~cover])
            out.append((d, len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        return Counter(out)
    for length, hot in ((200, 1 << 14), (64, 2)):
        monkeypatch.setattr(suffixes, "HOT", hot)
        assert Counter(map(tuple, suffixes.without_repeats(docs, length).collect())) == brute(rows, length)
    assert suffixes.without_repeats(empty).count() == 0


def test_chains_cut_repeated_passages(docs, rows, empty):
    found = chains.repeats(docs).cache()
    out = chains.without(docs, found)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = Counter()
    for d, t in {(r.doc_id, r.text) for r in out.collect()}:
        w = words(t)
        for window in {tuple(w[i:i + 51]) for i in range(len(w) - 50)}:
            left[window] += 1
    assert max(left.values()) == 1
    clean = {(d, t) for d, t in rows if d is not None and 6 < d < 40 and t != rows[6][1]}
    assert clean <= {(r.doc_id, r.text) for r in out.collect()}
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 40 for r in found.collect())
    assert chains.repeats(empty).count() == 0


def held(found, a, b):
    """Words of ``a``'s passages in the later of documents a and b."""
    return max((r.end_word - r.start_word for r in found if {r.doc_id, r.kept_id} == {a, b}), default=0)


def test_chains_do_not_depend_on_hubs(spark):
    """Passages made of lines that other documents hold, too, and passages of
    which a third document holds a part only."""
    lines = [prose(10) for _ in range(60)]
    rows = [(i, f"{prose(20)} {line} {prose(20)}") for i, line in enumerate(lines * 3)]
    for i in range(10):
        common, whole = " ".join(lines[6 * i:6 * i + 6]), prose(60)
        rows += [(1000 + j, f"{prose(15)} {common} {prose(15)}") for j in (10 * i, 10 * i + 1)]
        rows += [(2000 + j, f"{prose(15)} {whole} {prose(15)}") for j in (10 * i, 10 * i + 1)]
        rows += [(2002 + 10 * i + j, f"{prose(15)} {' '.join(whole.split(' ')[12 * j:12 * j + 35])} {prose(15)}") for j in range(3)]
    found = chains.repeats(frame(spark, rows)).collect()
    assert all(held(found, base + 10 * i, base + 10 * i + 1) >= 60 for base in (1000, 2000) for i in range(10))
    assert all(r.doc_id >= 1000 and r.doc_id % 10 < 2 for r in found)


def copied(passage, unequal, kinds):
    """The passage with so many words, but the outer ones, changed, left out or
    put in: columns of the alignment that are not equal."""
    out = passage.split(" ")
    for at in sorted(RNG.sample(range(1, len(out) - 1), unequal), reverse=True):
        kind = RNG.choice(kinds)
        out[at:at + 1] = [] if kind == "out" else [out[at], f"y{RNG.random()}"] if kind == "in" else [f"y{RNG.random()}"]
    return " ".join(out)


def test_chains_find_every_fuzzy_passage(spark):
    rows, pairs = [], []
    for kinds in (["change"], ["change", "in", "out"]):
        for n in (51, 60, 80, 100):
            for percent in (0, 5, 10, 15, 20):
                for _ in range(10):
                    passage, i = prose(n), 2 * len(pairs)
                    pairs.append((i, i + 1, n, percent, kinds))
                    # the rest differs in every word
                    rows += [(i + j, " ".join([*(f"a{RNG.random()}" for _ in range(20)), p, *(f"a{RNG.random()}" for _ in range(20))])) for j, p in enumerate((passage, copied(passage, n * percent // 100, kinds)))]
    # every fifth word changed: no five words in a row are left
    rows += [(9000, prose(30) + " " + (p := prose(54))), (9001, changed(p, 5))]
    found = chains.repeats(frame(spark, rows)).collect()
    assert [p for p in [*pairs, (9000, 9001)] if not held(found, *p[:2])] == []
    assert all(r.doc_id // 2 == r.kept_id // 2 and r.similarity >= 0.8 for r in found)


def test_chains_split_at_large_gaps(spark):
    one, two = prose(5000), prose(5000)
    rows = [(i, f"{one} {' '.join(f'{i}a{j}' for j in range(n))} {two}") for i, n in ((1, 20000), (2, 21000))]
    found = sorted((r.start_word, r.end_word, r.kept_start) for r in chains.repeats(frame(spark, rows)).collect())
    assert found in ([(0, 5000, 0), (25000, 30000, 26000)], [(0, 5000, 0), (26000, 31000, 25000)])
    frags = np.array([[0, 5000, 0, 5000], [25000, 30000, 26000, 31000]])
    other = np.r_[np.arange(25000), np.arange(50000, 51000), np.arange(25000, 30000)]
    assert len(list(chains.align(np.arange(30000), other, frags, 50, 80))) == 2


def test_passages_match_brute_force():
    for _ in range(300):
        equal = np.array([RNG.random() < RNG.choice([0.6, 0.8, 0.95]) for _ in range(60)])
        got = chains.passages(equal, 20, 80)
        ranges = [(a, z) for a in range(60) for z in range(a + 20, 61) if equal[a] and equal[z - 1] and 100 * equal[a:z].sum() >= 80 * (z - a)]
        assert all(r in ranges for r in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        # no range is left that no passage touches
        assert all(any(a < end and z > begin for begin, end in got) for a, z in ranges)


def test_decontamination_finds_items(spark, docs, rows, empty):
    item = " ".join(rows[10][1].split(" ")[20:50])
    fuzzy = changed(" ".join(rows[11][1].split(" ")[5:45]), 41)
    short = " ".join(rows[12][1].split(" ")[3:6])
    items = spark.createDataFrame([(1, item), (2, fuzzy), (3, short), (4, None), (5, ""), (None, item), (1, item), (6, prose(30))], "item_id long, text string")
    found = decontaminate.matches(docs, items)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(10, 1), (10, None), (11, 2), (12, 3)} <= got and 6 not in {i for _, i in got}
    best = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.similarity) for r in decontaminate.report(found).collect()}
    assert best[10, 1] == (20, 50, 1.0)
    assert {10, 11, 12} & {r.doc_id for r in decontaminate.clean(docs, found).collect()} == set()
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(60)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] * 8), (404, [1.0, 2.0]), (420, [3.0, 4.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, tile=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = [(i, v) for i, v in data if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    for q, v in usable:
        if q % 20 == 0:
            near = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), i) for i, w in usable if i != q and len(w) == len(v))[:20]
            assert [(n + 1, i, -s) for n, (s, i) in enumerate(near)] == sorted(got.get(q, []))
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_warc_round_trip(spark):
    data = [(i, f"http://x/{i}", RNG.choice(["a", "bb", "", None, prose(30)])) for i in range(60)] + [(None, None, "a"), (3, "u\r\nv", "bb")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    digests = []
    for _ in range(2):
        uri = workspace(spark, "test-warc")
        manifest = warc.write(pages, uri, roll_bytes=2000)
        digests.append(sorted((r.file, r.sha256) for r in manifest.collect()))
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, uri).collect())
    assert digests[0] == digests[1] and len(digests[0]) > 3
    newest = {}
    for i, _, h in data:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    expected = Counter()
    for i, _, h in data:
        b, top = (h or "").encode(), newest.get(h or "")
        again = top is not None and (i is None or i < top)
        expected[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None] += 1
    assert got == expected
    uri = workspace(spark, "test-warc")
    warc.write(pages.limit(0), uri)
    assert warc.read(spark, uri).count() == 0


def test_bpe_equals_the_library(spark, docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    reference, own = tokenizers.Tokenizer.from_file(PATH), bpe.load(PATH)
    extra = ["Hello, World's 123!!", "ΑΣ ΣΑΣ İ ẞ", "x<|endoftext|>y<|ENDOFTEXT|>", "ab" * 700, "é ẛ̣ ", "\x85a\xa0b", "!" * 300]
    for text in [*[t or "" for _, t in rows], *extra, *["".join(RNG.choice("abthe inger'sré!?1 \n<|>Σ") for _ in range(80)) for _ in range(300)]]:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.encoded(text)[2] == reference.decode(ids, skip_special_tokens=False) == own.decode(ids)
    out = bpe.encode(docs, PATH, ["doc_id"], ids=True).collect()
    assert len(out) == len(rows)
    assert {r.ids_sha256 for r in out if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\l<s>", "[[INST]", "<s", "", None, "a\\b", "<</s>", "end\\"]
    data = [(c, t, RNG.choice(["user", "assistant", "system", None]), RNG.choice(nasty)) for c in range(30) for t in range(RNG.randint(1, 6))]
    data += [(99, 0, "user", "tie"), (99, 0, "assistant", "tie"), (99, 0, "user", "tie"), (None, None, "assistant", "x")]
    made = chat.examples(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    for r in made.collect():
        text = r.formatted[r.loss_start:r.loss_end]
        assert "</s>" not in text and "[INST]" not in text and (not r.has_target or r.formatted[r.loss_end:] == "</s>")
    for r in chat.read_back(made).collect():
        own = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in data if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(text for _, role, text in own if role == "assistant")


def test_quality_classifier_learns_and_scores_all(spark, docs, rows, empty):
    good, bad = [(i, prose(80)) for i in range(0, 300, 2)], [(i, "BUY NOW!! " * 30) for i in range(1, 300, 2)]
    labelled = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    machine = quality.fit(labelled, labels)
    got = quality.score(labelled, machine, ["doc_id"]).where("doc_id >= 200").collect()
    assert len(got) == 100 and all((r.predicted == 1) == (r.doc_id % 2 == 0) for r in got)
    scored = quality.score(docs, machine, ["doc_id", "n_chars", "text"]).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality.accepted(labelled, machine).columns == labelled.columns
    assert quality.score(empty, quality.fit(empty, labels), ["doc_id"]).count() == 0


def test_pipeline_on_odd_documents(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(rows[20][1].split(" ")[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 20 not in out and 40 not in out and {10, 11, 12, 30} <= out
