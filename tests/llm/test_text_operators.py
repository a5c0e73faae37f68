import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb, exp, log

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import imatch, mixing, ngrams, packing, pages, queries, repeats, rules, sharding, simhash, toxicity
from emberline.llm.components import connected_components
from tests.llm import edge

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return edge.docs(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


OPERATORS = {
    "op1": lambda d, lab: toxicity.score(d, toxicity.fit(d, lab)),
    "op2": lambda d, lab: sharding.shard(d),
    "op3": lambda d, lab: ngrams.quality(d, lab),
    "op5": lambda d, lab: imatch.fingerprints(d),
    "op6": lambda d, lab: repeats.remove_repeats(d),
    "op7": lambda d, lab: rules.judge(d, lab),
    "op8": lambda d, lab: simhash.near_duplicates(d),
    "op9": lambda d, lab: mixing.mix(d, mixing.quality_weights(lab)),
    "op10": lambda d, lab: packing.pack(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_one_row_each(spark, docs, name):
    got = OPERATORS[name](docs, edge.labels(spark))
    ids = Counter(r["doc_id"] for r in got.collect()) if name != "op10" else Counter(r["doc_id"] for r in got.where("piece = 0").collect())
    assert ids == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    full = OPERATORS[name](edge.docs(spark), edge.labels(spark))
    none = OPERATORS[name](edge.docs(spark, empty=True), edge.labels(spark, empty=True))
    assert none.count() == 0 and none.columns == full.columns
    assert OPERATORS[name](edge.docs(spark), edge.labels(spark, empty=True)).count() == full.count()


def test_toxic_rows_are_found_and_clean_ones_left(spark):
    r = random.Random(1)
    data, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = edge.words(r, 40).split()
        if toxic:
            for x in r.sample(range(40), 3):
                w[x] = r.choice(("Zonk", "blarg", "quux" + edge.words(r, 1)))
        data.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(data, edge.COLUMNS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.fit(d, lab)).collect()
    held = [x for x in got if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert np.mean([x["predicted"] == int(x["doc_id"] % 6 == 0) for x in held]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    blind = toxicity.score(d.where("false").union(d).withColumn("lang", F.lit("zz")), toxicity.fit(d, lab)).collect()
    assert {x["doc_id"]: x["score"] for x in blind} == {x["doc_id"]: x["score"] for x in got}


def test_label_model_estimates_accuracies_and_correlations_from_votes_alone():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    bad = vote(0.6)
    v = np.column_stack([vote(0.95), vote(0.9), vote(0.9), vote(0.85), bad, bad, bad])  # three copies of one bad voter
    model = toxicity.LabelModel(v, 0.3)
    tied = {frozenset((i, int(u))) for i, u in enumerate(model.up) if u >= 0}
    assert tied == {frozenset((4, 5)), frozenset((5, 6))} or tied == {frozenset((4, 5)), frozenset((4, 6))} or tied == {frozenset((4, 6)), frozenset((5, 6))}
    assert ((model.posterior > 0.5) == y).mean() > 0.96 > ((v.sum(axis=1) > 0) == y).mean()
    p = model.posterior
    for j, right in enumerate((0.95, 0.9, 0.9, 0.85, 0.6)):
        assert abs(((p * (v[:, j] == 1)).sum() + ((1 - p) * (v[:, j] == -1)).sum()) / len(y) - right) < 0.04
    given = np.where(rng.random(4000) < 0.9, y, ~y)  # wrong labels don't change who votes well
    assert ((model.calibrated(given) > 0.5) == y).mean() > 0.96


def test_shards_are_exact_gapless_and_repeatable(docs, rows):
    got = sharding.shard(docs, 5).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[i]) for i in range(5)]
    assert max(sizes) - min(sizes) <= 1 and {r["law"] for r in got} == {"rows"}
    crc = {i: zlib.crc32(t.encode()) for i, t, _ in rows}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in got if r["doc_id"] is not None)
    again = sharding.shard(docs.repartition(7), 5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_communication_matrix_has_hypergeometric_rows():
    draws = [sharding.communication_matrix([30, 20], [25, 25], s) for s in range(3000)]
    assert all((m.sum(axis=1) == [30, 20]).all() and (m.sum(axis=0) == [25, 25]).all() for m in draws)
    x = np.array([m[0, 0] for m in draws])
    want = np.random.default_rng(1).hypergeometric(25, 25, 30, 30000)
    assert abs(x.mean() - 15) < 0.15 and abs(x.var() - want.var()) < 0.35
    assert sharding.hypergeometric(np.random.default_rng(2), 10**12, 10**12, 10**6) in range(495_000, 505_000)


def test_hypergeometric_probabilities_are_exact_at_any_size():
    for good, bad, drawn in ((5, 7, 6), (1, 1, 1), (300, 20, 310), (40, 4000, 100), (10**6, 10**5, 777), (10**11, 15 * 10**11, 10**5), (10**15, 10**15, 10**6), (10**6, 10**12, 10**9)):
        lo, hi = max(0, drawn - bad), min(drawn, good)
        mode = (drawn + 1) * (good + 1) // (good + bad + 2)
        for k in {lo, hi, mode, max(lo, mode - 3), min(hi, mode + 5)}:
            # a sum of logarithms of exact ratios, from whichever end has less terms
            small = min(drawn, 2000)
            if drawn > small or k < 0:
                continue
            want = Fraction(comb(good, k) * comb(bad, drawn - k), comb(good + bad, drawn))
            assert abs(sharding.log_probability(k, good, bad, drawn) - (log(want.numerator) - log(want.denominator))) < 1e-9, (k, good, bad, drawn)
    for good, bad, drawn in ((10**11, 15 * 10**11, 10**5), (10**15, 10**15, 10**6), (10**6, 10**12, 10**9)):
        mode = (drawn + 1) * (good + 1) // (good + bad + 2)
        width = 12 * int((drawn * good / (good + bad)) ** 0.5) + 60
        k = np.arange(max(0, mode - width), min(drawn, good, mode + width) + 1)
        total = sum(exp(sharding.log_probability(int(x), good, bad, drawn)) for x in k)
        assert abs(total - 1) < 1e-7, (good, bad, drawn, total)


def test_shuffle_is_uniform(spark):
    """Every row is as likely in every place, whatever its source, and neighbours are no likelier to stay together."""
    n, runs = 24, 40
    d = spark.createDataFrame([(i, "x" * i) for i in range(n)], "doc_id long, text string").cache()
    where, together = np.zeros((n, n)), 0
    for seed in range(runs):
        got = sharding.shard(d, 4, seed).select("doc_id", "shard", "slot").collect()
        place = {r["doc_id"]: r["shard"] * 6 + r["slot"] for r in got}
        together += sum(abs(place[i] - place[i + 1]) == 1 for i in range(n - 1))
        for i, p in place.items():
            where[i, p] += 1
    chi = ((where - runs / n) ** 2 / (runs / n)).sum()
    assert abs(chi - (n - 1) ** 2) < 4 * (2 * (n - 1) ** 2) ** 0.5  # degrees of freedom
    mean = runs * (n - 1) * 2 / n
    assert abs(together - mean) < 4 * mean**0.5


def plain_kneser_ney(texts: list[str]):
    """P(word | the word before) of the interpolated modified model, straight from its definition."""
    two = Counter(p for t in texts for w in [["<", *t.split(), ">"]] for p in zip(w, w[1:]))
    one = Counter(b for _, b in two)

    def discounts(level):
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [max(0.1, min(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.9 * i)) for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0

    less2, less1 = discounts(two), discounts(one)
    total, spare = Counter(), Counter()
    for (a, _), c in two.items():
        total[a] += c
        spare[a] += less2(c)

    def p(a: str, b: str) -> float:
        low = (one[b] - less1(one[b])) / len(two) + sum(map(less1, one.values())) / len(two) / (len(one) + 1)
        return (two[a, b] - less2(two[a, b])) / total[a] + spare[a] / total[a] * low if total[a] else low

    return p, one


@pytest.mark.parametrize("block,rounds", [(ngrams.BLOCK, (1, 1)), (700, (3, 2))])
def test_perplexities_match_brute_force(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(ngrams, "HELD", 0.0)
    monkeypatch.setattr(ngrams, "ROUNDS", rounds)
    r = random.Random(9)
    vocabulary = edge.words(r, 60).split()
    text = lambda: " ".join(r.choice(vocabulary) if r.random() < 0.8 else edge.words(r, 1) for _ in range(12))
    data = [(i, text() + " \t\né 漢"[: i % 6], ("en", "de")[i % 5 > 3], "s", 1) for i in range(200)] + [(900, "", "en", "s", 0), (901, "q# " * 900, "xx", "s", 1), (902, None, None, "s", 1)]
    good = set(range(0, 200, 2)) | {902}
    d = spark.createDataFrame(data, edge.COLUMNS)
    got = {x["doc_id"]: x for x in ngrams.quality(d, spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int"), block=block).collect()}
    name = lambda x: x[2] if x[2] == "en" else "*"
    models = {m: plain_kneser_ney([x[1] or "" for x in data if x[0] in good and name(x) == m]) for m in ("en", "*")}
    assert len(got) == len(data)
    for x in data:
        w = ["<", *(x[1] or "").split(), ">"]
        logs = [np.log(models[name(x)][0](a, b)) for a, b in zip(w, w[1:])]
        assert got[x[0]]["model"] == name(x) and abs(np.log(got[x[0]]["perplexity"]) + np.mean(logs)) < 3 / ngrams.STEPS
    p, one = models["en"]
    assert all(abs(sum(p(a, b) for b in one) + p(a, "none") - 1) < 1e-9 for a in ("<", "none", vocabulary[0]))


def test_pairs_are_counted_alike_in_chunks(monkeypatch):
    r = random.Random(4)
    texts = [edge.words(r, n).encode() for n in (0, 1, 30, 900)] + [b" \t ", b"x" * 500 + b"  y\x0b z", b"", "é漢 é漢 <".encode()]
    whole, ids = ngrams.counted(iter(texts), 3), list(ngrams.pairs(iter(texts), 3))[0][0]
    assert whole[3].sum() == len(ids) == sum(len(t.split()) + 1 for t in texts)
    for chunk in (1, 7, 400):
        monkeypatch.setattr(ngrams, "CHUNK", chunk)
        assert all((a == b).all() for a, b in zip(whole, ngrams.counted(iter(texts), 3)))
        assert (np.concatenate([i for i, _, _ in ngrams.pairs(iter(texts), 3)]) == ids).all()
    keys = np.sort(whole[0] >> ngrams.UNSENT)
    assert (ngrams._unpack_keys(ngrams._pack_keys(keys)) == keys).all()


def test_words_have_keys_of_their_own():
    words = sorted({w for (t,) in duckdb.sql("select coalesce(text, '') from '/root/testdata/sf0.1/documents.parquet'").fetchall() for w in t.encode().split()} | {bytes([a, b]) for a in range(33, 256) for b in range(33, 256)})
    start, keys = ngrams.word_keys(np.frombuffer(b"\n ".join(words), np.uint8), 0)
    assert len(words) > 100_000 and len(start) == len(words) == len(set(keys.tolist()))
    again = [ngrams.word_keys(np.frombuffer(b"  " * (i % 5) + w, np.uint8), 0)[1] for i, w in enumerate(words[:300])]
    assert np.concatenate(again).tolist() == keys[:300].tolist()
    assert not set(keys.tolist()) & set(ngrams.word_keys(np.frombuffer(b" ".join(words), np.uint8), 1)[1].tolist())


def test_what_the_model_gathers_grows_with_the_text():
    sizes = []
    for sf in ("0.01", "0.1"):
        texts = duckdb.sql(f"select coalesce(text, '') from '/root/testdata/sf{sf}/documents.parquet'").fetchall()
        sizes.append((sum(len(t) for (t,) in texts), len(ngrams.counted((t.encode() for (t,) in texts), 0)[0])))
    (small, few), (large, many) = sizes
    assert many / few > 0.7 * large / small


def test_junk_is_dropped(spark):
    r = random.Random(3)
    good = [(i, edge.words(r, 50), "en", "s", 1) for i in range(200)]
    junk = [(1000 + i, "#$%& !!! |<> " * 20, "en", "s", 1) for i in range(20)]
    d = spark.createDataFrame(good + junk, edge.COLUMNS)
    got = ngrams.quality(d, spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")).collect()
    assert not any(x["kept"] for x in got if x["doc_id"] >= 1000) and np.mean([x["kept"] for x in got if x["doc_id"] < 200]) > 0.9


def test_held_out_pages_are_told_apart():
    model = pages.default_model()
    right = total = 0
    for page, truth in pages.labelled_pages(200, 77):
        nodes = pages.nodes_of(pages.parse(page))
        pages.measure(nodes)
        got = [p >= 0.5 for x, p in zip(nodes, model.marginals(nodes)) if x.text is not None]
        right, total = right + sum(a == b for a, b in zip(got, truth)), total + len(truth)
    assert right / total > 0.985


def test_marginals_are_exact_on_a_small_tree():
    root = pages.parse("<div><p>a b c.</p><ul><li>d</li><li>e f</li></ul></div>")
    nodes = pages.nodes_of(root)
    pages.measure(nodes)
    model = pages.default_model()
    z = [max(-20, min(20, sum(model.weights.get(f, 0) for f in pages.features(x)))) for x in nodes]
    up = [nodes.index(x.parent) if x.parent else None for x in nodes]
    total, each = 0.0, np.zeros(len(nodes))
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        e = sum(a * b for a, b in zip(z, y)) + sum(model.pairs.get(x.tag, model.pairs["*"])[y[u]][y[i]] for i, (x, u) in enumerate(zip(nodes, up)) if u is not None)
        total += np.exp(e)
        each += np.exp(e) * np.array(y)
    assert np.allclose(each / total, model.marginals(nodes), atol=1e-9)


def test_awkward_pages(spark):
    html = ["", None, "plain words", "<p>un<b>closed <p>two &amp; three&nbsp;<br>four<p>", "<script>x</p>", "<article><h1>T</h1><p>one\n two</p><p>&lt;b&gt; &#x41;</article><footer>f", "<" * 50 + ">", "<div " * 300]
    d = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)] + [(None, None, "<article><p>x y z.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in pages.main_text(d).collect()}
    assert got[0]["text"] == got[1]["text"] == got[4]["text"] == "" and got[1]["n_chars"] == 0 and len(got) == 9
    assert got[5]["text"] == "T\none two\n<b> A" and got[5]["n_chars"] == 15
    assert pages.main_text(d.where("false")).count() == 0


def plain_article(page: str) -> str:
    """The blocks between ``<article>`` and its end, for pages whose markup is well formed."""
    inside = page.split("<article>")[1].split("</article>")[0]
    blocks = [" ".join(pages._html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|ul|ol|li|div|section|blockquote|pre|table|tr|td|th)\b[^>]*>", inside)]
    return "\n".join(x for x in blocks if x)


def test_pages_of_the_table_give_their_articles(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = pages.main_text(table).join(table.drop("url"), "page_id").collect()
    assert len(got) == table.count() > 100
    for r in got:
        assert r["text"] == plain_article(r["html"]) and r["n_chars"] == len(r["text"])


def test_long_and_repeated_pages(spark):
    long = "<article><h1>T</h1>" + "".join(f"<p>Sentence number {i} of a very long text, which goes on.</p>" for i in range(40_000)) + "</article>"
    rows = [(1, "u", long), (1, "u", long), (2, "u", "<article><p>One text, twice.</p></article>"), (2, "u", "<article><p>One text, twice.</p></article>")]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))).collect()
    assert len(got) == 4 and got[0]["text"].count("\n") == 40_000
    assert got[0]["n_chars"] == len(got[0]["text"]) > 2_000_000
    assert Counter(r["text"] for r in got) == Counter([pages.extract(long, pages.default_model())] * 2 + ["One text, twice."] * 2)


@pytest.mark.parametrize("part", ["<b>", "</div>", "<div>", "<a href='x'>y", '<a "', "<p '", "<li><div>", "<ul><li>x", "<td><b>", "<script ", "<!--", "</b>z"])
def test_parsing_takes_time_in_proportion(part):
    page = part * 60_000
    start = time.process_time()
    pages.parse(page)
    assert time.process_time() - start < 6


def test_open_elements_close_as_a_search_up_the_path_says():
    r = random.Random(11)
    tags = "div p li ul ol td tr table th dt dd dl option section tbody".split()

    def plain(page: str):
        root = node = pages.Node("#root", (), None)
        for m in pages.TOKEN.finditer(page):
            tag, x = m[3].lower(), node
            if m[2]:
                while x.parent and x.tag != tag:
                    x = x.parent
                node = x.parent or node
                continue
            if node.tag == "p":
                node = node.parent
            if tag in pages.CLOSES:
                x = node
                while x.parent and x.tag not in pages.LIMITS and x.tag not in pages.CLOSES[tag]:
                    x = x.parent
                while x.parent and x.tag in pages.CLOSES[tag]:
                    x = node = x.parent
            node = pages.Node(tag, (), node)
        return [(x.tag, x.depth) for x in pages.nodes_of(root)]

    for _ in range(400):
        page = "".join(f"<{'/' * (r.random() < 0.3)}{r.choice(tags)}>" for _ in range(40))
        assert [(x.tag, x.depth) for x in pages.nodes_of(pages.parse(page))] == plain(page)


def test_fingerprints_of_copies_and_edits(docs, rows):
    got = imatch.fingerprints(docs).collect()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    single = [r for r in order if sum(r[0] == x[0] for x in order) == 1]
    by = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            by[next(t for i, t, _ in rows if i == r["doc_id"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    have = {r["doc_id"]: r for r in got}
    for (i, t, _), (j, u, _) in zip(single, single[1:]):
        if i - j == 1 and j:
            k = len(t) // 3
            edited = t[: len(t) - k] + u[:k]
            assert have[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and have[i]["n_chars"] == len(t)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_lexicon_has_the_terms_of_the_band_and_no_others(spark):
    r = random.Random(9)
    common = [edge.words(r, 1) + str(i) for i in range(300)]
    texts = [" ".join(w for i, w in enumerate(common) if r.random() < (i + 1) / 600) + "".join(f" rare{j}x{k}" for k in range(500)) for j in range(200)]
    df = Counter(w for t in texts for w in set(t.lower().split()))
    band = {w for w, n in df.items() if 2 <= n <= 60}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = imatch.lexicon(d, len(texts))
    words = spark.createDataFrame([(j, w) for j, w in enumerate(df)], "doc_id long, text string")
    rows = imatch.with_fingerprint(words, "text", "fp", kept).select("text", F.exists(F.slice("fp", 1, 32), lambda x: x != 0).alias("kept")).collect()
    assert len(rows) > 100_000 and 50 < len(band) and {x["text"] for x in rows if x["kept"]} == band


def java_hash(value, seed=42):
    """XXH64 of a long as 8 bytes, or of a string's bytes, as a signed number."""
    data = value.to_bytes(8, "little", signed=True) if isinstance(value, int) else value.encode()
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprints(rows: list[tuple[int, str]], band=imatch.BAND):
    """doc_id -> the result's columns, straight from the definition; ids are distinct."""
    words = lambda t: [w for w in regex.split(imatch.WORDS, t.lower()) if w]
    frequency = Counter(w for _, t in rows for w in set(words(t)))
    kept = {w for w, n in frequency.items() if band[0] * len(rows) <= n <= band[1] * len(rows)}

    def many(hashes, seed=42):
        for h in hashes:
            seed = java_hash(h, seed)  # an array's hash is that of each element seeded by the hash so far
        return seed if hashes else 42

    def of(text):
        own = sorted({java_hash(w) for w in words(text) if w in kept})
        every = sorted({java_hash(w) for w in words(text)})
        out = []
        for level, (subsets, parts) in enumerate(imatch.LEVELS):
            # a hash's part of the level: low bits pick one of four first, the bits above the rest
            step = max(1, subsets // 4)
            coarse = parts // step
            for a in range(subsets // step):
                for b in range(step):
                    mine = [h for h in own if (h >> (17 + 12 * level)) % coarse == a and (h >> (17 + 12 * level + (coarse - 1).bit_length())) % step == b]
                    out.append((many(mine) & 0xFFFFFFFE) + 1 if mine else 0)
        return out, many(own or every)

    def like(x, y):
        if x[1] == y[1]:
            return 1.0
        some = [(p, q) for p, q in zip(x[0], y[0]) if p or q]
        return sum(p == q for p, q in some) / len(some) if some else 0.0

    text = lambda f: "".join(format(x & 0xFFFFFFFF, "08x") for x in (*f[0], f[1]))
    order, out = sorted(rows, reverse=True), {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(of(t)), text(of(edited)), like(of(t), of(edited)), like(of(t), of(u)))
    return out


def test_fingerprints_match_brute_force(spark):
    r = random.Random(12)
    common = edge.words(r, 400).split()
    texts = [" ".join(r.choice(common) if r.random() < 0.9 else edge.words(r, 1) for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += [texts[3], texts[4].upper() + "!", "", "Ünï 漢字 " + texts[5], texts[6] + " " + texts[7], "rare%d" % 1]
    d = spark.createDataFrame([(3 * i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(5)
    got = {x["doc_id"]: (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"], x["near_edited"], x["near_next"]) for x in imatch.fingerprints(d, (0.05, 0.4)).collect()}
    want = plain_fingerprints([(3 * i, t) for i, t in enumerate(texts)], (0.05, 0.4))
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4] and abs(got[i][4] - want[i][4]) < 1e-12 and abs(got[i][5] - want[i][5]) < 1e-12, i
    assert len({w[4] for w in want.values()}) > 10 and any(0 < w[5] < 1 for w in want.values())


@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_doc_id_is_dealt_out_and_keeps_its_order(spark, monkeypatch, hot):
    monkeypatch.setattr(imatch, "TASK_BYTES", 1000)
    r = random.Random(13)
    rows = [(hot if i % 3 else i, edge.words(r, 8)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near, n = imatch.neighbours(d)
    sizes = Counter(x["bucket"] for x in near.where(~F.col("guard")).where(F.col("doc_id").eqNullSafe(hot)).select("bucket").collect())
    assert n == 300 and len(sizes) > 40 and max(sizes.values()) < 30
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, java_hash(x[1])), reverse=True)
    want = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()) for (i, t), (_, u) in zip(order, order[1:] + order[:1]))
    assert Counter((x["doc_id"], x["edited_sha256"]) for x in imatch.fingerprints(d).collect()) == want


def test_single_document_is_its_own_next(spark):
    r = imatch.fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


def test_fingerprints_are_the_same_however_ranges_are_cut(spark, docs, monkeypatch):
    plain = Counter(map(tuple, imatch.fingerprints(docs).collect()))
    monkeypatch.setattr(imatch, "RANGES", 3)
    monkeypatch.setattr(imatch, "TASK_BYTES", 2000)
    assert Counter(map(tuple, imatch.fingerprints(docs).collect())) == plain


def covered(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("levels,combined", [(None, 20_000), (((3, 2),), 2), (((2, 2), (6, 13), (12, 0)), 7), (((0, 0),), 5)])
def test_repeats_match_brute_force(spark, monkeypatch, levels, combined):
    if levels:
        monkeypatch.setattr(repeats, "LEVELS", levels)
        monkeypatch.setattr(repeats, "COMBINED", combined)
    r = random.Random(5)
    passages = [edge.words(r, n) for n in (30, 50, 90)]
    texts = [(r.choice(passages)[r.randint(0, 40) :] + edge.words(r, r.randint(0, 60)) + r.choice(passages) + "é" * r.randint(0, 120)) for _ in range(40)]
    texts += ["y" * 450, "ab" * 180, texts[0], "z" * 199, "z" * 199, "q" * 200, "q" * 200, "w" * 200, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: tuple(x)[1:] for x in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == covered([t.encode() for t in texts], 200)
    kept = {x["doc_id"]: x["text"] for x in repeats.without_repeats(df).collect()}
    assert all(hashlib.sha256(kept[i].encode()).hexdigest() == g[3] or "é" in texts[i] for i, g in got.items())


def test_repeats_in_awkward_rows(docs, rows):
    got = Counter(tuple(x) for x in repeats.remove_repeats(docs).collect())
    want = covered([t.encode() for _, t, _ in rows], 200)
    assert got == Counter((r[0], *w) for r, w in zip(rows, want))


def test_columns_find_what_direct_comparison_finds():
    rng = np.random.default_rng(4)
    columns = rng.integers(0, 2, (40, 300)).astype(np.uint16)
    found = repeats.repeated_starts(columns, 8, 33)
    for s in range(33):
        seen = Counter(columns[s : s + 8, i].tobytes() for i in range(300))
        assert [seen[columns[s : s + 8, i].tobytes()] > 1 for i in range(300)] == found[s].tolist()


def test_rules_count_what_they_say():
    (n, chars, symbols, dup, repeat), _ = rules.statistics("a b c d e f a b c d e\nx #$\n\nx #$\n  ")
    assert (n, chars, symbols, dup, repeat) == (15, 17, 4, 1, 10)
    r = random.Random(6)
    for _ in range(50):
        w = [r.choice("abc").encode() for _ in range(r.randint(0, 40))]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        slow = sum(any(grams[tuple(w[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(w) - 5) + 1)) for i in range(len(w)))
        assert rules.repeated_words(w) == slow


def test_forest_drops_junk_and_keeps_good(spark):
    r = random.Random(7)
    data = [(i, edge.words(r, r.randint(20, 90)) if i % 8 else " ".join(x + r.choice(("%%%", "!!", " |", "###")) for x in edge.words(r, r.randint(20, 90)).split()), "en", "s", 1) for i in range(800)]
    d = spark.createDataFrame(data, edge.COLUMNS)
    got = {x["doc_id"]: x for x in rules.judge(d, spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(0, 800, 2)], "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([got[i]["kept"] for i in range(800) if i % 8]) > 0.97 and np.mean([got[i]["kept"] for i in range(0, 800, 8)]) < 0.3


def test_threshold_counts_labels_outside_the_forests_sample(spark):
    r = random.Random(8)
    data = [(i, edge.words(r, r.randint(20, 90)) if i % 8 else " ".join(x + r.choice(("%%%", "!!", " |", "###")) for x in edge.words(r, r.randint(20, 90)).split()), "en", "s", 1) for i in range(800)]
    d = spark.createDataFrame(data, edge.COLUMNS)
    inside = {x[0] for x in d.where(rules.share(F.col("doc_id"), 11) < 0.5).select("doc_id").collect()}
    marks = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(800) if i not in inside], "doc_id long, quality int, toxic int")
    got = rules.judge(d, marks, sample=400).collect()
    assert 200 < len(inside) < 600 and np.mean([x["kept"] for x in got if x["doc_id"] % 8 == 0]) < 0.1
    assert np.mean([x["kept"] for x in got if x["doc_id"] % 8]) > 0.9


def slow_fingerprint(text: str) -> int:
    w = text.encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("ranges", [None, (4, 3, 1), (4, 1 << 20, 1)])
def test_near_duplicates_match_brute_force(docs, rows, monkeypatch, ranges):
    if ranges:
        monkeypatch.setattr(simhash.code_links, "__defaults__", ranges)
    got = Counter(tuple(x) for x in simhash.near_duplicates(docs).collect())
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
    least = defaultdict(list)
    for (i, _, _), c in zip(rows, label):
        least[c].append(i)
    want = Counter((i, format(f, "016x"), min((x for x in least[c] if x is not None), default=None)) for (i, _, _), f, c in zip(rows, fps, label))
    assert got == want


@pytest.mark.parametrize("size,least,step", [(50, 1, 7), (200, 5, 1 << 13), (10_000, 1, 64)])
def test_code_links_connect_as_all_pairs_do(spark, monkeypatch, size, least, step):
    monkeypatch.setattr(simhash, "STEP", step)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for _ in range(6)), base[0] ^ rng.integers(0, 256, 150, dtype=np.uint64)]))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    label = np.arange(len(codes))
    for _ in range(60):
        label = np.array([label[row].min() for row in near])
    signed = codes.view(np.int64).tolist()
    roots = {r["node"]: r["root"] for r in connected_components(simhash.code_links(spark.createDataFrame([(c,) for c in signed], "fp long"), 4, size, least)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for c, x in zip(signed, label):
        groups[roots.get(c, c)].add(c)
        want[x].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("bucket,few,many,hot,held", [(2048, 64, 8192, 1 << 16, 1 << 19), (1, 3, 8, 20, 50), (256, 64, 100, 150, 10)])
def test_block_links_connect_as_all_pairs_do(spark, monkeypatch, bucket, few, many, hot, held):
    for name, x in zip(("BUCKET", "FEW", "MANY", "HOT", "HELD"), (bucket, few, many, hot, held)):
        monkeypatch.setattr(simhash, name, x)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    flips = [base.copy() for _ in range(6)]
    for f in flips:
        for _ in range(4):
            f ^= np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *flips, base[0] ^ rng.integers(0, 256, 150, dtype=np.uint64)]))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    for masks in (simhash.agreements(n, 4) for n in (100, 10**7, 10**12)):
        agree = np.any([(codes[:, None] ^ codes[None]) & m == 0 for m in masks], axis=0)
        assert agree[near].all()
    label = np.arange(len(codes))
    for _ in range(60):
        label = np.array([label[row].min() for row in near])
    signed = codes.view(np.int64).tolist()
    roots = {r["node"]: r["root"] for r in connected_components(simhash.block_links(spark.createDataFrame([(c,) for c in signed], "fp long"))).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for c, x in zip(signed, label):
        groups[roots.get(c, c)].add(c)
        want[x].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_buckets_compare_few_of_the_pairs_of_many_codes():
    for n in (10**5, 10**6, 10**7, 10**8, 10**9):
        masks = simhash.agreements(n, 4)
        assert sum(n >> int(m).bit_count() for m in masks) <= 15 * simhash.BUCKET and len(masks) <= 15


def test_upper_nodes_drop_whole_groups_of_the_table():
    texts = duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet'").fetchall()
    codes = np.unique(np.array([simhash.fingerprint((t or "").encode()) for (t,) in texts], np.uint64))
    links = simhash.RangeLinks(codes, 4)
    index = links.index
    assert len(codes) > 5000 and len(index.value) > 3
    assert (index.dropped[1:-1] > 0).all() and index.dropped[1] > 0.5 * index.compared[1]
    assert index.compared.sum() < 0.55 * len(codes) * (len(codes) - 1) / 2  # of all pairs of codes
    near = np.argwhere(np.triu(np.bitwise_count(links.codes[:, None] ^ links.codes[None]) <= 4, 1))
    root = links._top(links.root)
    assert len(near) and (root[near[:, 0]] == root[near[:, 1]]).all()
    plain = {frozenset(map(int, p)) for p in near}
    got = {frozenset((int(a), int(b))) for q, c in simhash.GrayIndex(links.codes).search(links.codes, 4) for a, b in zip(q, c) if a != b}
    assert got == plain


def test_a_large_group_of_near_codes_isnt_compared_pair_by_pair():
    r = np.random.default_rng(3)
    flips = [np.uint64(1) << r.integers(0, 64, 20_000, dtype=np.uint64) for _ in range(2)]
    codes = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips[0] ^ flips[1] ^ r.integers(0, 256, 20_000, dtype=np.uint64) * np.uint64(1 << 20))
    links = simhash.RangeLinks(codes, 4)
    assert len(codes) > 15_000 and len(set(links._top(links.root))) < 20
    assert links.index.compared[0] < 0.1 * len(codes) ** 2 / 2
    other = np.unique(codes ^ np.uint64(1 << 63))
    before = links.index.compared[0]
    u, _ = links.link(other)
    assert len(u) > 0.99 * len(other) and links.index.compared[0] - before < 0.2 * len(codes) * len(other)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))


def test_mix_meets_targets_and_reruns_agree(docs, spark):
    got = mixing.mix(docs, mixing.quality_weights(edge.labels(spark))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5), mixing.quality_weights(edge.labels(spark)), rows_each=2).collect()))
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-9 for r in got)


def test_mix_matches_sql(spark):
    ours = queries.op9_mixing(spark, FOLDER).toPandas().sort_values("doc_id").reset_index(drop=True)
    theirs = duckdb.sql(mixing.MIX_SQL.format(documents=f"'{FOLDER}/documents.parquet'", labels=f"'{FOLDER}/labels.parquet'")).df().sort_values("doc_id").reset_index(drop=True)
    assert all((ours[c] == theirs[c]).all() for c in theirs.columns)


def plain_encoder():
    vocabulary = Tokenizer.from_file(packing.default_paths()[0])
    return lambda text: vocabulary.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_plain_call(spark):
    plain, own = plain_encoder(), packing.encoder(*packing.default_paths())
    for t in ("a <|endoftext|> d", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext |>", "漢字 🙂\u0300é \u200b\x00", "'s 'S don't", " \n\n  x\t"):
        assert own(t) == plain(t), t
    assert 50256 in own("a <|endoftext|> d")
    r = random.Random(10)
    for _ in range(400):
        t = "".join(chr(r.choice((r.randint(9, 126), r.randint(160, 0x24F), r.randint(0x2010, 0x2030), 32, r.randint(0x300, 0xD7FF)) if r.random() < 0.3 else (r.randint(32, 126), 10, 32, r.randint(0xC0, 0xFF)))) for _ in range(r.randint(0, 80)))
        assert own(t) == plain(t), t
    folder = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    want = {}
    for i, t in duckdb.sql(f"select doc_id, coalesce(text, '') from '{folder}/documents.parquet'").fetchall():
        ids = np.array([*plain(t), 0], "<u4")
        for k, (start, n) in enumerate(packing.piece_bounds(len(ids), 2048)):
            want[i, k] = (start, n, zlib.crc32(ids[start : start + n].tobytes()))
    assert len(want) > 900 and got == want


def test_packs_are_whole_gapless_and_few(docs, rows):
    got = packing.pack(docs, with_ids=True).collect()
    encode = plain_encoder()
    parts, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
        parts[r["doc_id"]].append((r["start"], r["piece"], tuple(r["ids"])))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, _ in rows:
        if i:  # a doc_id of its own
            assert sum((list(x) for _, _, x in sorted(parts[i])), []) == [*encode(t), 0]
    for p in places.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_plan_is_close_to_the_bound_and_places_all():
    rng = np.random.default_rng(9)
    for _ in range(6):
        sizes = Counter(np.minimum(2048, rng.lognormal(rng.uniform(4, 6.8), 0.9, 4000).astype(int) + 1).tolist())
        p = packing.plan(sizes, 2048)
        assert {x: int(n) for x, n in enumerate(p.taken) if n} == dict(sizes)
        use = np.zeros(p.sequences, np.int64)
        for length, _, n, first, offset in sorted(p.rows, key=lambda r: r[4]):
            assert (use[first : first + n] == offset).all()
            use[first : first + n] += length
        assert use.max() <= 2048 and use.min() > 0
        assert p.sequences <= 1.02 * max(-(-sum(k * v for k, v in sizes.items()) // 2048), sum(v for k, v in sizes.items() if k > 1024)) + 2



def test_fewest_sequences_of_all_group_counts_are_taken():
    r = random.Random(6)
    for most in (300, 900, 2048):
        sizes = dict(Counter(r.randint(1, most) for _ in range(600)))
        p = packing.least_plan(sizes, 2048)
        assert p.sequences == min(packing.plan(sizes, 2048, g).sequences for g in packing.GROUPS)
        assert p.sequences * 2048 >= sum(x * n for x, n in sizes.items()) and {x: int(p.taken[x]) for x in sizes} == sizes
    assert packing.least_plan({}, 2048).sequences == 0 and packing.least_plan({2048: 3}, 2048).sequences == 3
