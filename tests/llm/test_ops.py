"""The text operators against brute force on one small corpus with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagraph.llm import decontaminate, jaccard, lines, mixing, passages, quality, secrets, suffix, tokens, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, key long, spans string, n long, size long"


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice(["ta", "ri", "mo", "éa", "ks", "ül", "ne"]) for _ in range(r.randrange(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    shared, lines3 = prose(90), "one line here\nand a second\n\nthen a third\n"
    texts = [None, "", " \n\t ", "a", "Two words", "x" * 900, "!!!! " * 30, "the same again " * 60, prose(4000)]
    texts += [prose(r.randrange(5, 200)) for _ in range(25)]
    base = prose(200)
    for i in range(12):  # near copies, and copies of them
        words = base.split(" ")
        for _ in range(i // 2):
            words[r.randrange(len(words))] = f"edit{i}"
        texts += [" ".join(words)] * (1 + i % 3)
    texts += [prose(30) + " " + shared + " " + prose(20) for _ in range(4)]
    texts += [prose(5) + "\n" + lines3 + prose(9) for _ in range(3)]
    texts += ["Token = 'abcdefgh12' and password:short api_KEY=\"zzzzzzzzzz\" token=secret:abcdefghij", f"é AKIA{'A1' * 8} " + "0f" * 20 + " ghp_" + "a" * 36, "SECRET" * 3]
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[40], "en", "src1"), (3, "another text of the same id", "en", "src2")]
    return [(*x, 1, "clash", 2, 3) for x in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def empty(docs):
    return docs.where("false").select("doc_id", "text", "source")


def test_jaccard(docs, rows):
    sets = []
    for r in rows:
        w = words(r[1], True)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    want = collections.Counter((r[0], len(sets[i]), min(least[root(i)]) if sets[i] else r[0]) for i, r in enumerate(rows))
    assert bag(jaccard.jaccard_report(docs)) == want
    assert jaccard.jaccard_report(empty(docs)).count() == 0


def test_bitmap_bound():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert jaccard.bound(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_quality(docs, rows):
    want = collections.Counter()
    for r in rows:
        w, text = words(r[1]), r[1] or ""
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        own = [x for x in text.split("\n") if WORD.search(x)]
        m = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered))
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        bad = m[1] < 2 * m[0] or m[1] > 20 * m[0] or m[2] >= m[0] or 10 * m[3] > 3 * (text.count("\n") + 1) or 2 * len(re.findall("[A-Z]", text)) > m[1] or 2 * text.count("!") > m[0]
        want[(r[0], *m, failed, not failed and not bad)] += 1
    assert bag(quality.quality_report(docs)) == want
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_filter(docs).count() == sum(n for k, n in want.items() if k[-1])
    assert quality.quality_report(empty(docs)).count() == 0


def test_secrets(docs, rows):
    want = collections.Counter()
    for r in rows:
        text, found = r[1] or "", []
        for rank, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, text):
                if len(m[rule.value]) >= rule.least:
                    found.append((m.start(1), rank, m.end(1), rule.kind))
        found.sort()
        base = [x for x in found if x[1] < 3]
        join = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in xs)
        count = [sum(x[1] == i for x in base) for i in range(3)]
        want[(r[0], *count, hashlib.sha256(join(base).encode()).hexdigest(), join(found))] += 1
    assert bag(secrets.secret_report(docs)) == want
    assert sum(n for k, n in want.items() if k[5]) >= 2
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert not any(re.search("AKIA|abcdefgh12", t) for t in clean.values())
    assert secrets.secret_report(empty(docs)).count() == 0


def test_suffix(docs, rows):
    data = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    want = collections.Counter()
    for r, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want[(r[0], len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert bag(suffix.suffix_report(docs)) == want
    assert suffix.suffix_report(empty(docs)).count() == 0


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    shards = tokens.write_tokens(docs, shard_ids=3000)
    got = sorted((tuple(r) for r in tokens.read_tokens(shards).collect()), key=lambda r: r[1])
    coded = {(r[0], r[1]): library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == collections.Counter((r[0], len(coded[r[0], r[1]]), crc(coded[r[0], r[1]])) for r in rows)
    assert tokens.read_tokens(tokens.write_tokens(empty(docs))).count() == 0


def test_shard_random_access():
    r = np.random.default_rng(2)
    phrase = r.integers(0, 300, 40)
    docs = [(i if i else None, np.append(np.concatenate([phrase] * int(r.integers(0, 30)) + [r.integers(0, 300, 9)]), 2)) for i in range(60)]
    data = tokens.write_shard(docs, 50257)
    shard = tokens.Shard(data)
    assert len(shard.rules) and len(shard.symbols) < shard.n_ids
    assert (tokens.expansion_lengths(shard.rules.astype(np.uint16), 50257) == shard.length[50257:]).all()
    for i, (d, ids) in enumerate(docs):
        assert shard.doc_ids[i] == d and (shard.document(i) == ids).all()
        for a, b in ((0, 1), (3, 17), (5, len(ids)), (len(ids) - 1, len(ids))):
            assert (shard.slice(i, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("seed", range(3))
def test_encoder(seed):
    import pyarrow as pa

    from sonagraph.llm import textnum

    r = random.Random(seed)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "Zed", "é", "中", "ع", "1", "²", "'s", "'re", "’", "...", "\u00a0", "\u3000", "\u0085", "\0", "\x1c", "<|endoftext|>", "🙂", " x", "\r\n", "¿"]
    encoder = tokens.Encoder(tokens.default_tokenizer())
    for _ in range(60):
        texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(40)]
        if r.random() < 0.8:
            texts = [t.replace("<|endoftext|>", "q") for t in texts]
        got = list(encoder.texts(*textnum.utf8(pa.array(texts))))
        assert [x.tolist() for x in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_passages(docs, rows):
    out = {(r["doc_id"], r["n_words"]): r for r in passages.passage_report(docs).collect()}
    planted = [i for i, r in enumerate(rows) if r[1] and len(r[1]) < 3000 and sum(o[1] is not None and r[1] != o[1] and shares(r[1], o[1]) for o in rows)]
    assert len(planted) > 10
    for i in planted:
        assert out[rows[i][0], len(words(rows[i][1]))]["n_covered"] >= 50
    for i, r in enumerate(rows):
        row = out[r[0], len(words(r[1]))]
        copies = [o[0] for o in rows if words(o[1], True) == words(r[1], True) and o[0] is not None]
        if words(r[1]) and r[0] is not None:
            assert row["class_id"] == min(copies)
        if i not in planted and len(copies) == 1 and i in range(9, 34):
            assert row["n_covered"] == 0
    assert passages.passage_report(empty(docs)).count() == 0


def shares(a, b, n=51):
    w, v = words(a, True), words(b, True)
    have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return any(tuple(v[i : i + n]) in have for i in range(len(v) - n + 1))


def linked(report):
    """The pairs of class ids that the report links, from its partners."""
    rows = report.collect()
    pairs = {(r["class_id"], p) for r in rows for p in r["partners"]}
    ends = collections.Counter(x for p in pairs for x in p)
    assert {r["class_id"]: r["n_links"] for r in rows if r["n_links"]} == ends  # one passage a pair here
    return {tuple(sorted(p)) for p in pairs}


def test_passage_links(spark):
    """Two texts share 60 words, others quote 35 of them each: links as brute force finds them."""
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        shared = prose(60)
        texts += [prose(40) + shared + prose(40) for _ in range(2)]
        for i in range(12):
            at = i % 2 * 25
            texts.append(prose(30) + shared[at : at + 35] + prose(30))
    wide = prose(80)
    texts += [prose(20) + wide + prose(20) for _ in range(8)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {(i, j) for j in range(len(texts)) for i in range(j) if shares(" ".join(texts[i]), " ".join(texts[j]), 50)}
    assert len(want) == 6 + 28
    assert linked(passages.passage_report(df)) == want


def changed_pairs(n_words, rate, n=60):
    """Texts 2i and 2i + 1 share a passage in which words were replaced at this rate."""
    r = random.Random(f"{n_words} {rate}")
    prose = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    texts = []
    for _ in range(n):
        shared = prose(n_words)
        there = [w if r.random() >= rate else f"x{r.randrange(10**6)}" for w in shared]
        # the ends agree, so that the passage is as long as brute force says
        there[:2], there[-2:] = shared[:2], shared[-2:]
        texts += [prose(30) + shared + prose(30), prose(30) + there + prose(30)]
    return texts


def common_passage(a, b, margin=30):
    """Do the planted stretches hold a passage, by the quadratic longest common subsequence?"""
    a, b = a[margin:-margin], b[margin:-margin]
    row = [0] * (len(b) + 1)
    for w in a:
        last, row = row, [0]
        for j, v in enumerate(b):
            row.append(last[j] + 1 if w == v else max(last[j + 1], row[j]))
    return row[-1] >= passages.IDENTITY * len(a)


#: (words, share of words changed, least recall)
RECALL = [(60, 0, 1), (60, 0.05, 0.95), (60, 0.1, 0.9), (60, 0.2, 0.5), (80, 0.1, 0.95), (120, 0.2, 0.7)]


def test_passage_recall(spark):
    """Found pairs against brute force, at identities of 0.75 to 1."""
    texts = [t for n, rate, _ in RECALL for t in changed_pairs(n, rate)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {tuple(sorted((r["class_id"], p))) for r in passages.passage_report(df).collect() for p in r["partners"]}
    assert all(i % 2 == 0 and j == i + 1 for i, j in got)
    for k, (n, rate, least) in enumerate(RECALL):
        want = [i for i in range(120 * k, 120 * k + 120, 2) if common_passage(texts[i], texts[i + 1])]
        recall = np.mean([(i, i + 1) in got for i in want])
        print(f"{n} words, {rate} changed: {len(want)} passages, recall {recall:.2f}")
        assert recall >= least


def test_equal_stretch_beside_a_weak_chain(spark):
    """50 equal words, 30 others, 10 equal words: the chain of all of them is below the identity."""
    r = random.Random(9)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    head, tail = prose(50), prose(10)
    texts = [prose(20) + head + prose(30) + tail + prose(20) for _ in range(2)]
    out = passages.passage_report(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert [(r["n_links"], r["spans"]) for r in out.collect()] == [(1, "20:70")] * 2


def test_chains_against_quadratic():
    r = random.Random(3)
    for _ in range(50):
        pairs = sorted({(r.randrange(60), r.randrange(60)) for _ in range(25)})
        x, y = [p[0] for p in pairs], [p[1] for p in pairs]
        score = []
        for i in range(len(x)):
            best = max((score[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]), default=0)
            score.append(1 + max(0, best))
        got = passages.chains(x, y)
        assert all(a < b and c < d for a, b, c, d in got)
        if max(score) > 1.5:
            top = max(range(len(x)), key=lambda i: (score[i], -i))
            assert any(b == x[top] and d == y[top] for _, b, _, d in got)


def test_common():
    r = random.Random(4)
    for _ in range(100):
        a, b = [[r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert passages.common(a, b) == table[-1][-1]


def test_mixing(docs, rows):
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * free / sum(weight[t] for t in names if t not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).select(*got[0].asDict()).collect()), key=repr)
    assert mixing.mix(empty(docs)).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter()
    for r in got:
        copies[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert {r["size"] for r in mixed.select("size").collect()} == {3}  # the input's own column


@pytest.mark.parametrize("block", [decontaminate.MAX_BLOCK_BYTES, 400])
def test_decontamination(spark, docs, rows, block):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOW))
    items = [(1, " ".join((rows[30][1] or "").split(" ")[:14])), (2, "Two words"), (3, None), (4, "..."), (None, "x" * 900), (5, (rows[36][1] or "")[:300]), (5, (rows[36][1] or "")[:300]), (6, "of no text at all " * 5)]
    windows = collections.defaultdict(set)
    for name, text in items:
        w = split(text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[i : i + min(10, len(w))])].add("null" if name is None else str(name))
    want = collections.Counter()
    for r in rows:
        w, hit, names = split(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= own
        want[(r[0], len(w), len(hit), tuple(sorted(names)))] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs, benchmark, max_block_bytes=block).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), tuple(r["items"])) for r in found)
    assert got == want
    clean = decontaminate.decontaminate(docs, benchmark, max_block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[3])
    assert decontaminate.scan(decontaminate.decontaminate(docs, benchmark, remove="spans"), benchmark).where("size(items) > 0").count() <= sum(n for k, n in want.items() if k[3])
    report = decontaminate.contamination_report(docs, benchmark.where("false"))
    assert report.where("contaminated OR n_hit > 0").count() == 0 and report.count() == len(rows)


def test_urls(spark):
    urls_ = [None, "", "no scheme", "HTTP://Example.ORG/es/1?q#f", "x://org", "x://a.org/", "x://example.org/en/12", "x://m.example.com/fr/1", "x://b.com/de/", "x://comx/fr/", "x://a?b://c/d", "x://www.cheap-pills.example.net/en/1", "x://ththble.example.net/en/2"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls_)], "page_id long, url string, host string")
    got = [tuple(r)[1:] for r in urls.url_report(df).orderBy("page_id").collect()]
    assert [g[:3] for g in got] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.org", "/es/1", "example.org/es/"), ("org", "", None), ("a.org", "/", "org/"), ("example.org", "/en/12", "example.org/en/1"),
        ("m.example.com", "/fr/1", "com/fr/"), ("b.com", "/de/", "com/de/"), ("comx", "/fr/", None), ("a", "", None), ("www.cheap-pills.example.net", "/en/1", None), ("ththble.example.net", "/en/2", None),
    ]
    assert [g[3] for g in got if g[2]] == ["block", "allow", "block", "allow", "block"]  # the rules' verdicts
    assert [g[3] for g in got[:3]] == ["allow"] * 3 and [g[3] for g in got[-2:]] == ["block", "allow"]
    assert [urls.split_url(u) for u in urls_] == [g[:2] for g in got]
    assert urls.url_report(df.where("false")).count() == 0


def test_url_model_holds_out():
    rows = urls.default_labels()
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    model = urls.train([r for i, r in enumerate(rows) if i % 5])
    right = [(s >= 0.5) == bool(y) for s, (_, y) in zip(urls.score([urls.split_url(u) for u, _ in held], model), held, strict=True)]
    assert np.mean(right) > 0.95


def test_url_labels_are_not_the_pages(spark):
    """Hosts that no label names: known sites pass, and hosts held out whole are judged better than by chance."""
    table = [urls.split_url(u)[0] for u, _ in urls.default_labels()]
    names = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm", "example.")
    assert not [h for h in table if any(n in h for n in names)]
    known = ["github.com", "stackoverflow.com", "www.bbc.co.uk", "pubmed.ncbi.nlm.nih.gov", "mercedes-benz.com"]
    assert not set(known) & set(table)
    rows = [(i, f"https://{h}/en/") for i, h in enumerate(known)]
    report = urls.url_report(spark.createDataFrame(rows, "page_id long, url string"))
    assert [r["verdict"] for r in report.collect()] == ["allow"] * len(known)
    hosts = [(h, y) for y, hosts in ((1, urls.BAD), (0, urls.GOOD)) for h in hosts]
    right = []
    for fold in range(5):
        held = {h for i, (h, _) in enumerate(hosts) if i % 5 == fold}
        own = {head + h for h in held for head, _ in urls._PAGES}
        model = urls.train([r for r in urls.default_labels() if urls.split_url(r[0])[0] not in own])
        tested = [(h, y) for h, y in hosts if h in held]
        right += [(y, (s >= 0.5) == bool(y)) for s, (_, y) in zip(urls.score([(h, "/") for h, _ in tested], model), tested, strict=True)]
    each = [np.mean([ok for y, ok in right if y == label]) for label in (0, 1)]
    print(f"held-out hosts: {len(right)}, accuracy {np.mean([ok for _, ok in right]):.2f}, good {each[0]:.2f}, bad {each[1]:.2f}")
    assert min(each) > 0.6


def test_lines(docs, rows):
    first, placed = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        own = [(j, x) for j, x in enumerate((rows[i][1] or "").split("\n")) if WORD.search(x)]
        for k in range(len(own) - 2):
            key, here = tuple(x for _, x in own[k : k + 3]), (rows[i][0], own[k][0])
            first.setdefault(key, here)
            placed.append((i, key, here, [j for j, _ in own[k : k + 3]]))
    gone = collections.defaultdict(set)
    for i, key, here, at in placed:
        if first[key] != here:
            gone[i].update(at)
    want = collections.Counter()
    for i, r in enumerate(rows):
        own = (r[1] or "").split("\n")
        kept = "\n".join(x for j, x in enumerate(own) if j not in gone[i])
        want[(r[0], sum(bool(WORD.search(x)) for x in own), len(gone[i]), hashlib.md5(kept.encode()).hexdigest())] += 1
    assert bag(lines.line_report(docs)) == want
    assert lines.line_dedup(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert lines.line_report(empty(docs)).count() == 0


def test_lines_of_texts_that_share_an_id(spark):
    """Different texts without an id, or with the same one, keep a shared header once."""
    head = "one line\nand a second\nthen a third\n"
    df = spark.createDataFrame([(i, f"{head}{i} {j}") for i in (None, 7) for j in range(3)], "doc_id long, text string")
    removed = [(r["doc_id"], r["n_removed"]) for r in lines.line_report(df).collect()]
    assert sorted(n for i, n in removed if i is None) == [0, 3, 3]
    assert [n for i, n in removed if i == 7] == [3, 3, 3]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "of no text at all " * 5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        kept.append(now.count())
    assert kept[0] > kept[1] >= kept[2] > 0
    ids = collections.Counter(r["doc_id"] for r in now.select("doc_id").collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == ids


def test_bucket_counts_beyond_16_bits():
    import pandas as pd

    table = np.zeros(jaccard.CHUNK, np.uint32)
    table[:2] = 60_000, 7
    data = jaccard.zlib.compress(table.tobytes())
    total = jaccard._sum_chunks(pd.DataFrame({"counts": [data] * 3}))
    assert total[:2].tolist() == [180_000, 21]
    classes = jaccard._classes(np.array([60_000, 61_000, 70_000, 2_000_000, 90_000_000]), 60_000.0)
    assert (np.diff(classes.astype(int)) > 0).all()


def test_bucket_counts_restart_before_they_are_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "shingle_rows", lambda batch: ((i, np.zeros(30_000, np.uint64)) for i in range(4)))
    batch = pa.RecordBatch.from_arrays([pa.array([""])], ["text"])
    got = [np.frombuffer(jaccard.zlib.decompress(x.as_py()), np.uint32)[0] for b in jaccard._count_buckets([batch], 18) for x in b.column("counts")]
    assert sum(map(int, got)) == 120_000 and len(got) > 1


def test_bucket_classes_are_the_same_by_any_number_of_lanes(spark, monkeypatch):
    df = spark.createDataFrame([(f"{i % 7} common words stand in all texts {i}",) for i in range(60)], "text string").repartition(6)
    want = jaccard.bucket_classes(df)
    assert want.any()
    monkeypatch.setattr(jaccard, "PART_BYTES", 64)
    assert (jaccard.bucket_classes(df) == want).all()


def test_near_duplicates_by_row(spark):
    r = random.Random(6)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, c = prose(80), prose(80), prose(80)
    near = [*a[:-1], "other"]
    rows = [(1, a, 0), (1, b, 1), (2, near, 2), (None, a, 3), (3, c, 4), (3, c, 5), (None, prose(50), 6), (4, [], 7), (4, [], 8)]
    df = spark.createDataFrame([(i, " ".join(t), n) for i, t, n in rows], "doc_id long, text string, stay long")
    kept = jaccard.near_duplicates(df)
    assert kept.columns == df.columns
    left = sorted(x["stay"] for x in kept.collect())
    assert left in ([0, 1, 4, 6, 7, 8], [0, 1, 5, 6, 7, 8])
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_internal_names_do_not_clash(docs):
    mine = docs.selectExpr("doc_id", "text", "source", "1 AS _words", "2 AS mix", "3 AS plan", "4 AS row", "5 AS covered", "6 AS stay")
    want = (1, 2, 3, 4, 5, 6)
    for out in (quality.quality_filter(mine), mixing.apply_mix(mine), lines.line_dedup(mine), jaccard.near_duplicates(mine)):
        assert out.columns[: len(mine.columns)] == mine.columns
        assert {tuple(r) for r in out.select(*mine.columns[3:]).collect()} == {want}


def test_texts_of_megabytes(spark):
    """One text far beyond the blocks, with a passage repeated in it, beside short ones."""
    import pyarrow as pa

    from sonagraph.llm import textnum

    r = random.Random(7)
    prose = lambda n: " ".join(f"{r.randrange(10**9):x}" for _ in range(n))
    shared = prose(200)
    long = f"{prose(150_000)}|{shared}|{prose(170_000)}({shared}){prose(9)}"
    assert len(long) > 2 * textnum.BLOCK_BYTES
    df = spark.createDataFrame([(1, long), (2, f"[{shared}]"), (3, prose(60))], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix.suffix_report(df).collect()}
    assert got == {1: (2 * len(shared), 2), 2: (len(shared), 1), 3: (0, 0)}
    encoder = tokens.Encoder(tokens.default_tokenizer())
    for text in (long, "x" * (tokens.ENCODE_BYTES + 9), " " * (tokens.ENCODE_BYTES + 9)):
        ids = next(iter(encoder.texts(*textnum.utf8(pa.array([text])))))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.held() < 2 * tokens.CACHE_BYTES
    n = {x["doc_id"]: x["n_shingles"] for x in jaccard.jaccard_report(df).collect()}
    words_ = long.split(" ")
    assert n[1] == len({tuple(words_[i : i + 5]) for i in range(len(words_) - 4)})


def test_frequent_passages(spark):
    """A passage that more texts hold than are paired with each other, some with changed words."""
    r = random.Random(10)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    wide, n = prose(70), 3 * passages.OFTEN
    texts = []
    for i in range(n):
        own = [w if i % 5 or r.random() > 0.05 else f"x{r.randrange(10**6)}" for w in wide]
        texts.append(prose(25) + own + prose(25))
    texts += [prose(120) for _ in range(5)]
    line = prose(12)  # a frequent line that is no passage
    texts += [prose(60) + line + prose(60) for _ in range(2 * passages.OFTEN)]
    out = {x["doc_id"]: x for x in passages.passage_report(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert min(out[i]["n_covered"] for i in range(n)) >= passages.MIN_WORDS and {out[i]["group_id"] for i in range(n)} == {0}
    assert min(out[i]["n_covered"] for i in range(n) if i % 5) >= 65  # a changed end costs the words beyond it
    assert all(out[i]["n_covered"] == 0 and out[i]["group_id"] == i for i in range(n, len(texts)))


def test_grammar_goes_on_until_no_pair_is_frequent():
    ids = np.tile(np.arange(500, dtype=np.int32), 1000)
    closed = np.zeros(len(ids), bool)
    closed[-1] = True
    rules, symbols, _ = tokens.compress(ids, closed, 50257)
    left = collections.Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
    assert max(left.values()) < tokens.MIN_COUNT and len(symbols) < 125 * tokens.MIN_COUNT
    assert (next(tokens.Shard(tokens.write_shard([(1, ids)], 50257)).documents())[1] == ids).all()


def test_link_below_frequent_pieces(spark):
    """Two texts share 60 words whose every seed is frequent: others quote 30 of them, which is no passage."""
    r = random.Random(12)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, texts = prose(60), []
    for i in range(12 * passages.OFTEN):
        at = i % 3 * 15
        texts.append(prose(25) + shared[at : at + 30] + prose(25))
    texts[50:50] = [prose(25) + shared + prose(25) for _ in range(2)]
    out = passages.passage_report(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["group_id"], x["spans"]) for x in out if x["n_links"]} == {(50, 50, "25:85"), (51, 50, "25:85")}


def test_blocks_keep_groups_together(spark, monkeypatch):
    """Texts that are paired with each other are sent to few blocks, a common partner to all of its own."""
    monkeypatch.setattr(passages, "BLOCK_PAIRS", 100)
    pairs = [(100 * g + i, 100 * g + j) for g in range(30) for j in range(14) for i in range(j)] + [(9000, 9001 + i) for i in range(500)]
    members = spark.createDataFrame([(c, c, 60) for c in {x for p in pairs for x in p}], "doc_id long, cls long, n_words long")
    dealt = passages._dealt(members, spark.createDataFrame(pairs, "cls long, partner long")).collect()
    assert sorted((x["cls"], x["partner"]) for x in dealt) == sorted(pairs) and len({x["block"] for x in dealt}) > 10
    places = {(c, x["block"]) for x in dealt for c in (x["cls"], x["partner"])}
    assert len(places) <= 30 * 14 + 500 + len({x["block"] for x in dealt})


def test_repeated_word_beside_a_longer_run(spark):
    """150 times one word holds every stretch of another text's 60."""
    r = random.Random(13)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = [prose(20) + ["du"] * n + prose(20) for n in (150, 60)]
    out = passages.passage_report(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["spans"] for x in out} == {0: "20:170", 1: "20:80"}


def test_components_of_few_and_of_many_edges(spark, monkeypatch):
    """Few edges are joined without rounds of scratch tables; both ways give the smallest node reachable."""
    from sonagraph.llm import graph

    r = random.Random(11)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000), (-(2**63), 2**63 - 1)]
    least = {x: x for u, v in edges if u != v for x in (u, v)}
    for _ in range(300):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    written = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, *done: written.append(label) or write(df, label, *done))
    frame = spark.createDataFrame(edges, "u long, v long")
    assert dict(graph.components(frame).collect()) == least
    assert written == ["components"]
    assert graph.components(frame.where("u = v")).count() == 0
    assert dict(graph.components(frame, few=0).collect()) == least
    assert written.count("edges") > 2


def test_passage_of_many_texts_costs_few_pairs(spark, monkeypatch):
    """A passage of n texts takes pairs in proportion to n, though its ends lie open in all of them; a chain that goes
    on beyond it, over words that many texts hold as well, is found."""
    r = random.Random(17)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared, head = prose(60), prose(8)
    texts = [f"{prose(30)} {shared} {prose(20)}" for _ in range(160)] + [f"{head} {prose(100)}" for _ in range(40)]
    texts += [f"{prose(12)} {head} {prose(18)} {shared} {prose(20)}" for _ in range(2)]
    pairs, aligned = [], passages._aligned
    monkeypatch.setattr(passages, "_aligned", lambda docs, members, found, *done: pairs.append(found.count()) or aligned(docs, members, found, *done))
    rows = passages.passage_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), partners=False).collect()
    got = {x["doc_id"]: x for x in rows}
    assert all(got[i]["spans"] == "30:90" and got[i]["group_id"] == 0 for i in range(160))
    assert all(got[i]["spans"] == "" for i in range(160, 200))
    assert [got[i]["spans"] for i in (200, 201)] == ["12:98"] * 2
    assert sum(pairs) < 10 * len(texts)


def test_extension_from_places_of_one_stretch():
    """Places that only equal words part are extended together: to where each would be extended by itself."""

    def alone(words, i, j, room, step):
        best = score = kept = 0
        for n in range(room):
            score += 1 if words[i + n * step] == words[j + n * step] else -2
            if score > best:
                best, kept = score, n + 1
            if score <= best - passages.DROP:
                break
        return kept

    r = random.Random(19)
    for _ in range(12):
        a = [r.randrange(3 if r.random() < 0.3 else 900) for _ in range(700)]
        b = [w if r.random() > 0.07 else r.randrange(900) for w in a]
        words = np.array([*a, *b, *a[:300]], np.uint64)
        i = np.array([r.randrange(700) for _ in range(900)])
        j = np.clip(i + 700 + np.array([r.choice([0, 0, 0, 0, 1, -3]) for _ in i]), 700, 1399)
        left, right = np.minimum(i + 1, j - 699), np.minimum(700 - i, 1400 - j)
        for room, step in ((left, -1), (right, 1)):
            want = [alone(words, *x, step) for x in zip(i.tolist(), j.tolist(), room.tolist(), strict=True)]
            assert passages._extend(words, i, j, room, step).tolist() == want
            # many places of a stretch cost the extension of its ends
        order, joined = passages._joined(np.concatenate([np.zeros(64, np.uint64), words, np.zeros(64, np.uint64)]), i, j, right, 1)
        assert sorted(order.tolist()) == list(range(900)) and joined.sum() > 400


def test_seeds_are_dealt_in_few_rows():
    """Each text's seeds, once each, whatever block and bucket they come in; only those of several texts go on."""
    import pyarrow as pa

    r = random.Random(20)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 400))) for _ in range(40)] + ["", None]
    texts += [f"{texts[3]} {texts[9]}", texts[5], "du " * 90 + texts[7]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    dealt = [x for part in passages._seeds([batch], 7) for x in part.to_pylist()]
    assert len(dealt) == 7 and sorted(x["bucket"] for x in dealt) == list(range(7))
    holders = collections.defaultdict(set)
    for x in dealt:
        for seed, cls in zip(np.frombuffer(x["seeds"], np.int64).tolist(), np.frombuffer(x["cls"], np.int64).tolist(), strict=True):
            holders[seed].add(cls)
    rows = pa.Table.from_pylist(sorted(dealt, key=lambda x: x["bucket"])).combine_chunks().to_batches(max_chunksize=2)
    got = [tuple(x.values()) for part in passages._shared(rows) for x in part.to_pylist()]
    assert sorted(got) == sorted((s, c, len(h)) for s, h in holders.items() if len(h) > 1 for c in h) and len(got) > 100


def test_rules_are_the_most_frequent_pairs():
    """A round takes the most frequent pairs, the smaller first among equals, whichever share a slot of the counts."""
    r = random.Random(21)
    pairs = [(r.randrange(50000), r.randrange(50000)) for _ in range(30000)]
    key = np.array([a << 16 | b for a, b in pairs], np.uint32)
    slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(12)
    shared = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] > 1)  # neighbours in one slot
    times = {pairs[i]: 32 + int(i) % 9 for i in [*shared[:200].tolist(), *range(500)]}
    ids = np.array([x for p in sorted(times) for _ in range(times[p]) for x in p], np.int32)
    closed = np.arange(len(ids)) % 2 == 1  # no pair goes on into the next
    rules, symbols, place = tokens.compress(ids, closed, 50257)
    want = sorted(times, key=lambda p: (-times[p], p))
    assert [tuple(x) for x in rules.tolist()] == want and len(symbols) == len(ids) // 2
    assert place.tolist() == list(range(0, len(ids), 2)) and symbols.tolist() == [50257 + want.index(tuple(p)) for p in ids.reshape(-1, 2).tolist()]
