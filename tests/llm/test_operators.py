"""The operators against brute force, round trips and held-out accuracy, with their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seqmotif.llm import chat, html_text, jaccard, neardup, packing, quality, sentencepiece, topk, toxicity, warc
from seqmotif.llm.common import block_pairs, components, forest
from seqmotif.session import scratch, stored, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score string, extra int"
ODD = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n\t", None, None), (4, "a" * 30000, "x", 1), (5, "word " * 9000, "x", 1), (6, "one two three", "x", 1), (6, "one two three", "x", 1), (None, "one two three", "x", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_components_and_forest(spark):
    rng = random.Random(4)
    for n in (0, 1, 30):
        edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n)] + [(k, k + 1) for k in range(100, 100 + n)]
        at = {v: v for e in edges for v in e}
        for _ in at:
            for a, b in edges:
                at[a] = at[b] = min(at[a], at[b])
        found = components(spark.createDataFrame(edges, "a long, b long"), spark, stored)
        got = {r.id: r.component for r in found.collect()}
        assert got == {v: c for v, c in at.items() if any(v in e and e[0] != e[1] for e in edges)}
    links = np.array([[1, 1, 0, 0], [1, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 1]], bool)
    a, b = forest(links)
    assert len(a) == 2 and all(links[x, y] for x, y in zip(a, b))


def test_block_pairs_meet_once(spark):
    df = block_pairs(spark.createDataFrame([(7, k) for k in range(50)], "g long, m long"), "g", "m", 8)
    met = defaultdict(int)
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.ba, r.bb].append((r.m, r.left))
    for (ba, bb), rows in groups.items():
        for i, (x, lx) in enumerate(rows):
            for y, ly in rows[i + 1 :]:
                if ba == bb or lx != ly:
                    met[frozenset((x, y))] += 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


def scored(df, spark, truth, threshold):
    rows = [r for r in df.collect() if r.held_out and r.doc_id in truth]
    assert all(r.predicted == int(r.score >= threshold) for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)


def test_quality_held_out(spark, docs):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert scored(quality.query(spark, documents, labels), spark, truth, 0.3) > 0.95
    odd = quality.classify(docs, labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.held_out} == {k for k, *_ in ODD if k is not None and zlib.crc32(str(k).encode()) % 5 == 0}
    assert quality.query(spark, docs.limit(0), labels).count() == 0


def test_toxicity_held_out_and_decoding(spark, docs):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert scored(toxicity.query(spark, documents, labels), spark, truth, 0.5) > 0.95
    odd = toxicity.classify(docs, labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    decoder = toxicity.Decoder(toxicity.language_model(documents))
    assert [decoder.restore(t) for t in ("i.d.i.o.t", "l0ser", "m o r o n", "Cl0wn!!", "loooser")] == ["idiot", "loser", "moron", "clown", "loser"]
    assert [decoder.restore(t) for t in ("2024", "$1.50", "10:30", "...")] == ["2024", "$1.50", "10:30", ""]
    spoken = spark.createDataFrame([("bass pass glass " * 300,)], "text string")
    assert toxicity.Decoder(toxicity.language_model(spoken)).restore("84$$") == "bass"


def test_language_model_counts_characters():
    import pyarrow as pa

    found = {}
    for batch in toxicity.count_trigrams(iter([pa.RecordBatch.from_pydict({"text": ["Éa “b", None, "", "日"]})])):
        found |= dict(zip(batch.column("gram").to_pylist(), batch.column("n").to_pylist()))
    expected = defaultdict(int)
    for text in ("Éa “b", "", "", "日"):
        codes = [toxicity.symbol(c) for c in f"  {text.lower()}  "]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            expected[(a * 28 + b) * 28 + c] += 1
    expected[0] = found[0] = 0  # blanks between texts
    assert found == expected


def test_classifiers_without_both_classes(spark, docs):
    for none in (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(3, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")):
        share = 0.5 if none.count() == 0 else 1 / 1.002 + 0.001 / 1.002
        for module in (quality, toxicity):
            assert all(abs(r.score - share) < 1e-6 for r in module.classify(docs, none).collect())


def test_viterbi_is_exact_on_small_lattices(spark):
    rng = np.random.default_rng(2)
    decoder = toxicity.Decoder(rng.random((28, 28, 28)) * 4 + 0.5)

    def cost(choice):
        a = b = 0
        total = 0.0
        for c, channel in choice:
            total += channel
            if c:
                s = toxicity.symbol(c)
                total += decoder.costs[a][b][s]
                a, b = b, s
        return total + decoder.costs[a][b][0]

    from itertools import product

    for token in ("l0ss", "a1a", "xxx", "b!t", "1.0"):
        best = min(product(*decoder.lattice(token)), key=cost)
        assert abs(cost(best) - min(cost(c) for c in product(*decoder.lattice(token)) if "".join(x for x, _ in c) == decoder.decode(token))) < 1e-9
    for token in ("letter", "aabb", "moon"):
        assert decoder.twice(token) == decoder.decode(token)


def test_viterbi_is_exact_with_many_states():
    decoder = toxicity.Decoder(np.random.default_rng(2).random((28, 28, 28)) * 12 + 0.1)
    token = "70143483|88$"
    best, most = {(0, 0): 0.0}, 0
    for step in decoder.lattice(token):
        fresh = {}
        for (a, b), cost in best.items():
            for c, channel in step:
                s = toxicity.symbol(c)
                state, total = ((b, s), cost + channel + decoder.costs[a][b][s]) if c else ((a, b), cost + channel)
                fresh[state] = min(total, fresh.get(state, total))
        best, most = fresh, max(most, len(fresh))
    least = min(cost + decoder.costs[a][b][0] for (a, b), cost in best.items())
    read = decoder.decode(token)
    spelled = {(0, 0, ""): 0.0}
    for step in decoder.lattice(token):
        fresh = {}
        for (a, b, text), cost in spelled.items():
            for c, channel in step:
                s = toxicity.symbol(c)
                state, total = ((b, s, text + c), cost + channel + decoder.costs[a][b][s]) if c else ((a, b, text), cost + channel)
                if read.startswith(state[2]):
                    fresh[state] = min(total, fresh.get(state, total))
        spelled = fresh
    cost = min(cost + decoder.costs[a][b][0] for (a, b, text), cost in spelled.items() if text == read)
    assert most > 24 and abs(cost - least) < 1e-9


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    special = [(7, "a <|endoftext|> b<|endoftext|>", "x", 1), (8, "<|endoftext|>", "x", 1), (9, "two  blanks \t x\n y", "x", 1)]
    rows = packing.query(spark, docs.unionByName(spark.createDataFrame(special, DOCS))).collect()
    expected = []
    for doc_id, text, *_ in ODD + special:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [(doc_id, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert packing.query(spark, docs.limit(0)).count() == 0


def best_fit_decreasing(histogram, capacity):
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = min((r for r in rooms if r >= length), default=None)
            if k is None:
                n += 1
                rooms.append(capacity - length)
            else:
                rooms.remove(k)
                rooms.append(k - length)
    return n


@pytest.mark.parametrize("histogram", [{1032: 120, 528: 120, 520: 120, 496: 240}, {683: 180, 700: 140, 690: 66, 666: 20, 512: 160, 520: 140, 513: 91, 515: 60, 505: 180, 342: 200, 350: 180}])
def test_program_beats_best_fit_decreasing(histogram):
    made = packing.plan(histogram)
    used = defaultdict(int)
    for times, config in made.groups:
        assert sum(n * k for n, k in config) <= 2048
        for n, k in config:
            used[n] += times * k
    assert used == histogram and made.slotted > 0.9 * sum(histogram.values())
    assert made.bound <= made.sequences <= 1.02 * made.bound and made.sequences < best_fit_decreasing(histogram, 2048)


def test_program_is_feasible_and_bounded():
    rng = random.Random(2)
    for _ in range(4):
        histogram = {n: rng.randint(1, 9) for n in rng.sample(range(2, 13), 5)}
        rows, found, bound = packing.fractional(histogram, 12, 60)
        cover = sum(c * x for c, x in found)
        assert all(r == [x] for r, x in zip(rows, sorted(histogram))) and all(cover[k] >= histogram[r[0]] * (1 - 1e-9) for k, r in enumerate(rows))
        total = sum(x for _, x in found)
        assert bound <= total * (1 + 1e-9) <= 1.1 * bound + 1e-9
        assert all(sum(n * r[0] for n, r in zip(c, rows)) <= 12 for c, _ in found)


def test_packing_is_near_the_bound():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[min(2048, int(rng.expovariate(1 / 500)) + 1)] += 1
    made = packing.plan(dict(histogram))
    groups, used = made.groups, defaultdict(int)
    for times, config in groups:
        assert sum(n * k for n, k in config) <= 2048
        for n, k in config:
            used[n] += times * k
    assert used == histogram
    assert sum(t for t, _ in groups) <= 1.005 * sum(n * k for n, k in histogram.items()) / 2048 + 1


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    extra = [" Hello  world\n\tfoo é 你好😀 ", "   x   ", "▁a▁▁ b", "ﬁ Ａ", "abc" * 60, "x\x00y", "<s> </s>"]
    texts = [t or "" for _, t, *_ in ODD] + extra + [r.text for r in table(spark, SF, "documents").limit(40).collect()]
    coder = sentencepiece.Encoder(sentencepiece.model_path())
    coded = coder.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == model.encode(texts)
    assert [coder.decode(c) for c in coded] == [t.replace("▁", " ") for t in texts]
    rows = sentencepiece.query(spark, docs).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)


def test_jaccard_against_brute_force(spark, docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(8, 120))] for _ in range(12)]
    rows = []
    for k in range(150):
        text = list(rng.choice(base)) if k % 3 else [rng.choice(words) for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(200 + k, t) for k, (_, t, *_) in enumerate(ODD)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.query(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for k, t in rows:
        w = (t or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    at = {k: k for k in sets}
    for _ in range(20):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    assert got == {k: (at[k], sum(a == k for a, _ in links)) for k in sets}
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    assert jaccard.query(spark, docs.limit(0)).count() == 0
    assert jaccard.repeats(0.999) == 15


def test_jaccard_at_a_lower_similarity(spark):
    assert jaccard.least_agreement(0.8) == 34 and jaccard.least_agreement(0.5) < 16
    rng = random.Random(7)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join([*base[:82], *(f"v{rng.randrange(10**6)}" for _ in range(38))])))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    links = {(a, b) for a in sets for b in sets if a != b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = {r.doc_id: r.n_links for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), (1, 2)).collect()}
    assert len(links) == 120 and got == {k: sum(a == k for a, _ in links) for k in sets}


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.standard_normal(16)], 1) for k in range(300)]
    rows += [(k, rows[0][1], 1) for k in (300, 301, 350)] + [(400, None, 1), (401, [float("nan")] * 16, 1), (402, [None] * 16, 1), (403, [1.0, 2.0], 1), (450, [3.0, 4.0], 2), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, topk.query(spark, df).collect()))
    whole = {k: [int(np.floor(256 * float(np.float32(x)))) for x in v] for k, v, _ in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in [k for k in whole if k % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.query(spark, df.limit(0)).count() == 0
    assert topk.query(spark, df.where("vec_id = 7")).count() == 0


def test_topk_with_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 4000)
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.standard_normal(8)]) for k in [*range(120), 50, 50, 6, 6, 100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    whole = [(k, [int(np.floor(256 * float(np.float32(x)))) for x in v], [float(np.float32(x)) for x in v]) for k, v in rows]
    expected = []
    for q in (0, 50, 100):
        vector = min((v, w) for k, w, v in whole if k == q)[1]
        best = sorted((-sum(a * b for a, b in zip(vector, w)), k) for k, w, _ in whole if k != q)[:5]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(map(tuple, topk.query(spark, df).collect())) == expected


def test_topk_gathers_few_pairs(monkeypatch):
    """Where bounds leave most pairs, one matrix product picks those that are worth a place: gathering them one by one took 0.6 GB of vectors out of reach."""
    rng = np.random.default_rng(8)
    whole = np.floor(256 * rng.standard_normal((4096, 64)) / 8).astype(np.int64)
    whole[3000:3010] = whole[5]
    shown, offer = [], topk.Search.offer
    monkeypatch.setattr(topk.Search, "offer", lambda self, q, c, block: (shown.append(len(q)), offer(self, q, c, block))[1])
    search = topk.Search(np.arange(64), whole[:64], 5)
    for first in range(0, 4096, 512):
        search.show(topk.Block(np.arange(first, first + 512), whole[first : first + 512]))
    scores = whole[:64] @ whole.T
    expected = [(q, c, int(scores[q, c])) for q in range(64) for c in sorted(set(range(4096)) - {q}, key=lambda c: (-scores[q, c], c))[:5]]
    assert search.rows() == expected and sum(shown) < 0.2 * 64 * 4096


def test_neardup(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        x = rng.standard_normal(24)
        if k % 2 and k > 20:
            y = np.array(rows[k % 20][1])
            x = y / np.linalg.norm(y) + rng.standard_normal(24) / np.sqrt(24) * rng.choice([0.01, 0.15, 0.2, 0.25])
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(k % 3)))
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("inf")] * 24, 1), (503, rows[0][1], None), (504, [1.0], 1), (505, [2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, y in rows if v and y is not None and np.isfinite(v).all() and any(v)}
    label = {k: y for k, _, y in rows}
    links = {(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98}
    found = sum(n for n, *_ in got.values())
    assert found >= 0.99 * len(links) and all(got[k][0] <= sum(a == k for a, _ in links) for k in got)
    assert got[504][:2] == (1, 504) and got[505][1] == 504 and got[500] == (0, 500, True) and got[501][0] == 0 and got[503][0] == 0


def test_neardup_copies_few_bytes(spark):
    """What goes to the buckets is a few times the vectors' own size, at any number of them: whole vectors under some thirty filters filled the disk at 0.6 GB."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    rows = [(k, "1", 64, v.tobytes()) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, dim int, vector binary")
    for n in (2000, 1_500_000):
        size = int(np.ceil((n / neardup.SHARE) ** (1 / neardup.PARTS)))
        sent = neardup.filtered(vectors, size, np.float32, True).selectExpr("sum(16 + length(code)) AS n").first().n
        assert sent < 6 * x.nbytes
    unit = neardup.unit([v.tobytes() for v in x], np.float32)
    raw = np.frombuffer(b"".join(neardup.encode(unit)), np.uint8).reshape(2000, -1)
    step, error = raw[:, :8].copy().view(np.float32).astype(float).T
    coded = raw[:, 8:].copy().view(np.int8) * step[:, None]
    assert (coded @ coded.T + error[:, None] * (1 + error) + error >= unit @ unit.T).all()


def test_neardup_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 32)), 90, 0), rng.standard_normal((1, 32)) + rng.standard_normal((120, 32)) * 0.14, rng.standard_normal((60, 32))]).astype(np.float32)
    rows = [(3 * k - 200, [float(a) for a in v], k % 2) for k, v in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2
    links = (unit @ unit.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)
    reach = np.linalg.matrix_power(links + np.eye(len(x)), 64) > 0
    expected = {r[0]: (int(n), min(3 * int(k) - 200 for k in np.flatnonzero(to))) for r, n, to in zip(rows, links.sum(1), reach)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == expected and 0 < links[90:210].sum() < 120 * 59


def test_warc(spark):
    big = "<p>" + "é✓x" * 40000 + "WARC/1.1\r\n" * 3 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = [(1, "http://a/ b\r\nX: y", big), (2, "u", big), (3, "u", None), (4, None, ""), (5, "u", "<p>x"), (5, "u", "<p>x"), (6, "u", "WARC/1.1\r\n")]
    path = scratch(spark)
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path, chunk=1000)
    got = sorted(map(tuple, warc.read(spark, path).collect()), key=str)
    digest = lambda t: warc.base32(hashlib.sha1((t or "").encode()).digest())
    first = {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}
    assert got == sorted(((k, len((t or "").encode()), digest(t), "revisit" if first[k] else "response", first[k]) for k, _, t in pages), key=str)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain  &amp;\n text", "plain & text"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>a<br>b<p>c &lt;d</article><footer>f</footer>", "T\n\na b\n\nc <d"),
        ("<div class='ad'>no<div>no</div></div><p>yes</p><form>no</form><script>var t='</p>'</script><p>too", "yes\n\ntoo"),
        ("<article><p>body text</p><div class=comments><article><p>me</article></div></article><aside>x</aside>", "body text"),
        ("<article><p>cut off", "cut off"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html) == text


PROSE = "This sentence stands for a paragraph of the main text of a page, as long as paragraphs are."
MORE = "Another paragraph goes on about the same matter, and it too is as long as paragraphs tend to be."


def test_html_ratios_pick_the_region():
    links = "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(12))
    page = f"<body><div><ul>{links}</ul></div><div class=x1><h1>Title</h1><p>{PROSE}<p>{MORE}<p>Short.<p>{PROSE}</div><div class=x2><ul>{links}</ul></div><div class=x3>(c) 2024 Someone</div></body>"
    expected = "\n\n".join(["Title", PROSE, MORE, "Short.", PROSE])
    assert html_text.extract(page) == expected
    assert html_text.extract(page.replace("class=x1", "")) == expected
    teaser = "<article><a href=/a>Next one</a></article>"
    assert html_text.extract(page.replace("</body>", teaser)) == expected


def test_html_ratio_decides_where_nothing_is_marked():
    chrome = "".join(f"<div><span>{w}</span><i>|</i><b>{w} {w}</b></div>" for w in ("Home", "About us", "Contact", "Terms"))
    page = f"<body>{chrome}<div><h1>Title</h1><p>{PROSE}<p>{MORE}<p>Short.<p>{PROSE}</div>{chrome}</body>"
    assert html_text.extract(page) == "\n\n".join(["Title", PROSE, MORE, "Short.", PROSE])
    assert "Contact" in html_text.extract(page, share=0)


def test_html_pages(spark):
    long = f"<article><p>{PROSE}</p>" + "".join(f"<p>{k} {MORE}</p>" for k in range(8000)) + "</article>"
    rows = [(1, "u", None, 5), (2, None, f"<nav>x</nav><p>{PROSE}", 5), (2, None, f"<nav>x</nav><p>{PROSE}", 5), (3, "u", long, None), (None, "u", "<nav>menu</nav>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.query(spark, df).collect()}
    assert html_text.query(spark, df).count() == 5 and html_text.query(spark, df.limit(0)).count() == 0
    assert (got[1].text, got[2].text, got[None].text) == ("", PROSE, "") and got[2].n_chars == len(PROSE)
    assert got[3].text.split("\n\n") == [PROSE, *(f"{k} {MORE}" for k in range(8000))]


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        (f"<div class='entry-header'><h1>T</h1></div><article><header><h1>H</h1></header><p>{PROSE}</p><p>{MORE}</p></article><header>x</header>", ["H", PROSE, MORE]),
        (f"<article><div class='entry-header'><h1>T</h1></div><p>{PROSE}</p><header class='header'>By me</header></article>", ["T", PROSE, "By me"]),
        (f"<div class='widget-main'><p>{PROSE}</p></div>", [PROSE]),
        (f"<main><h1>T</h1><p>{PROSE}</p><article><p>{MORE}</p></article></main>", ["T", PROSE, MORE]),
        (f"<article><p>{PROSE}</p><article><p>{MORE}</p></article><p>End.</p></article>", [PROSE, MORE, "End."]),
        (f"<article><p>{PROSE}</p></article><nav>x</nav><article><p>{MORE}</p><p>{PROSE}</p></article><article><p>{MORE}</p></article>", [PROSE, MORE, PROSE, MORE]),
    ],
)
def test_html_containers(html, lines):
    assert html_text.extract(html) == "\n\n".join(lines)


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        (f"<article><p class=notice>x<p>{PROSE}<p>{MORE}</article>", [PROSE, MORE]),
        (f"<article><ul><li class=ad>x<li>{PROSE}<li>{MORE}</ul><dl><dt class=ad>x<dd>{PROSE}</dl><table><tr><td class=ad>x<td>{MORE}<tr class=ad><td>x<tr><td>{PROSE}</table></article>", [PROSE, MORE, PROSE, MORE, PROSE]),
        (f"<article><ul><li class=ad>x<ul><li>y</ul>z<li>{PROSE}</ul></article>", [PROSE]),
        (f"<div class='content with-sidebar'><p>{PROSE}</p></div>", [PROSE]),
        (f"<article class='post comments-open'><p>{PROSE}</p></article>", [PROSE]),
        (f"<article><p>{PROSE}</p><h2 id='related-work'>Work</h2><section id='social-history'><p>{MORE}</p></section></article>", [PROSE, "Work", MORE]),
        (f"<div class='page header'><p>{PROSE}</p><div class='ad-box'>no</div><div class='big sidebar'>no</div></div>", [PROSE]),
        (f"<div id='page-sidebar'><p>{PROSE}</p></div><div class='site-footer'>no</div>", [PROSE]),
        (f"<article><p>{PROSE}</p><p>{MORE}</p><div class='big sidebar'>{MORE}</div></article>", [PROSE, MORE]),
    ],
)
def test_html_set_aside(html, lines):
    assert html_text.extract(html) == "\n\n".join(lines)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "b"), (3, 0, "tool", "[INST]<<NAME>>"), (4, None, None, None), (2, 2, "user", None), (5, 0, "user", "hi"), (5, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = stored(chat.paths(df), spark)
    nodes = chat.stream(turns.select("path", "role", "text"))
    tree = nodes.orderBy("start").collect()
    assert len(tree) == 7 and sum(r.uses for r in tree) == len(rows)
    place = 0
    for r in tree:
        assert r.start == place and r.position == sum(a.length for a in r.ancestors)
        place += r.length
        parent = [x for x in tree if bytes(r.path).startswith(bytes(x.path)) and x.path != r.path]
        assert [(a.start, a.length) for a in r.ancestors] == [(x.start, x.length) for x in sorted(parent, key=lambda x: len(x.path))]
    got = {r.conv_id: r for r in chat.read_back(turns, nodes).collect()}
    said = defaultdict(list)
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] or 0)):
        said[conv].append((role or "", text or ""))
    for conv, turn in said.items():
        learned = "".join(t for r, t in turn if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turn).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turn), len(learned))
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    for text in ("</s>[INST] ok [/INST]", "\\", "<\\s>", "<<s>>", "[[INST]"):
        assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))


def test_pipeline_keeps_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents").selectExpr("*", "'mine' AS score", "'x' AS Predicted", "doc_id AS own_id", "1 AS own_key", "2 AS kept_id", "true AS held_out", "3L AS _id")
    odd = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars", "score", "Predicted", "own_id", "own_key", "kept_id", "held_out", "_id")
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", docs.text.substr(1, 0)))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), spark)
        assert docs.count() <= before
    assert {r.score for r in docs.collect()} == {"mine"} and docs.columns[5:] == ["score", "Predicted", "own_id", "own_key", "kept_id", "held_out", "_id"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 4
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, SF), spark)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids and not any(labels[k].toxic for k in ids if k in labels)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.collect()} == ids


def test_suffix_array(monkeypatch):
    """Right for any alphabet; letters that fit into one number are sorted at once, as sorting is most of the cost of new units."""
    rng, sorts, argsort = np.random.default_rng(5), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or argsort(*a, **b))
    for n, letters, depth in ((1, 1, 16), (2, 1, 16), (3, 2, 1), (5, 2, 16), (300, 1, 16), (2000, 3, 16), (2000, 100, 16), (2000, 100_000, 16), (500, 2, 33)):
        points = rng.integers(0, letters, n)
        order = sentencepiece.suffix_array(points, depth)
        heads = [tuple(points[k : k + depth]) for k in order.tolist()]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
    sorts.clear()
    sentencepiece.suffix_array(rng.integers(0, 100, 2000), 16)
    assert len(sorts) <= 2


def test_packing_keeps_words():
    """A worker remembers a million words before it starts afresh, and starts afresh in the end."""
    coder = packing.Tokens(packing.tokenizer_path())
    for many, kept in ((1_000_000, True), (packing.WORDS + 1, False)):
        coder.known.update((f"{k}", b"") for k in range(many))
        coder.encode(["a word"])
        assert ("999999" in coder.known) is kept and "word" in coder.known
