"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and no rows."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import components, decontam, exact, jaccard, lines, packing, pii, queries, sharding, substring, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_chars long, size long, key string"
RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 4)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def corpus():
    base = prose(120, 1)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (3, 60, 119)]
    passage = prose(50, 2)
    texts = [None, "", " \n\t ", "one", "ONE", base, base, base.upper(), *near, prose(120, 3)]
    texts += [f"{prose(30, 10 + i)} {passage} {prose(30, 20 + i)}" for i in range(4)]
    texts += [prose(6000, 4), "a\nb\nc\nd\n\nb\nc\nd\nz", "x\nb \nc\nd\ny", "ü" * 50, "a  b c <|endoftext|> d's\t\n\n e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(5, base), (None, "one"), (None, prose(40, 5))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_no_rows(spark, empty):
    path = tokenizers.path("byte_bpe_50k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        packing.pack(empty, path), jaccard.jaccard_join(empty), substring.substring_dedup(empty), pii.personal_data(empty), sharding.shard(empty),
        decontam.contaminated(empty, items), warc.round_trip(pages), lines.line_dedup(empty), exact.exact_dedup(empty), toxicity.scored(empty, toxicity.fit(empty, labels)),
    ):
        assert df.count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    want = Counter()
    for i, text in corpus():
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want.update((i, k, s, m) for k, (s, m) in enumerate(packing.piece_bounds(n, 1024)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    ids = packing.tokenised(docs.where("doc_id = 20"), path, keep_ids=True).collect()
    got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(ids, key=lambda r: r["piece"])]).tolist()
    assert got == t.encode(corpus()[20][1], add_special_tokens=False).ids + [2]


def test_packed_ids(spark, docs):
    """Checksums of the ids of every piece, from the tokenizer alone."""
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t, want = Tokenizer.from_file(path), Counter()
    for i, text in corpus():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((i, k, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.piece_bounds(len(ids), 1024)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pack(docs, path).collect()) == want


def test_pack_histogram():
    counts = Counter(np.random.default_rng(3).integers(1, 1025, 5000).tolist())
    bins = packing.pack_histogram(dict(counts), 1024)
    used = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 1024
        for s in lengths:
            used[s] += times
    assert used == counts
    assert sum(t for _, t in bins) <= 1.03 * -(-sum(s * n for s, n in counts.items()) // 1024)


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return Counter((doc, len(s), least.get(x) if s else doc) for (doc, _), s, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(docs, n, percent):
    got = Counter(tuple(r) for r in jaccard.jaccard_join(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(corpus(), n, percent)


def test_jaccard_chains(spark):
    """Many near copies of one text, and chains that only link from neighbour to neighbour."""
    base = prose(60, 30).split()
    rows = [(i, " ".join(base[:i] + [f"w{i}"] + base[i + 1 :])) for i in range(0, 60, 2)]
    chain = prose(100, 31).split()
    rows += [(1000 + i, " ".join(chain[3 * i : 3 * i + 40])) for i in range(20)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 4, 80)


def test_trie():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)] + [np.arange(10, dtype=np.uint64)] * 2
    for q in sets[:20]:
        want = {(i, len(np.intersect1d(q, s))) for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))}
        assert set(jaccard.Trie(sets).similar(q, 60)) == want


@pytest.mark.parametrize("percent", [60, 85])
def test_prefix_tree(percent):
    """All pairs of different labels that share enough of their prefixes, and no others."""
    rng = np.random.default_rng(percent)
    base = [rng.permutation(np.arange(k * 40, k * 40 + 40)) for k in range(3)]
    sets = [np.sort(b[: rng.integers(20, 41)]).astype(np.uint64) for b in base for _ in range(25)]
    sizes, labels = np.array([len(s) for s in sets]), rng.integers(0, 30, len(sets))
    heads = [s[: len(s) - -(-percent * len(s) // 100) + jaccard.shared_least(len(s))] for s in sets]
    groups, signs = np.sort(rng.integers(0, 3, len(sets))), [jaccard.signature(s) for s in sets]
    members = jaccard.Members(groups, heads, sizes, labels, signs)
    got = {(i, j) for q, s in jaccard.PrefixForest(members, percent).similar(members) for i, j in zip(q.tolist(), s.tolist(), strict=True)}
    shared = lambda i, j: len(np.intersect1d(heads[i], heads[j]))
    want, linked = set(), set()
    for i, x in enumerate(sizes.tolist()):
        for j, y in enumerate(sizes.tolist()):
            if groups[i] == groups[j] and labels[i] != labels[j] and percent * max(x, y) <= 100 * min(x, y) and shared(i, j) >= jaccard.prefix_overlap(x, y, percent):
                want.add((i, j))
            if groups[i] == groups[j] and labels[i] != labels[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])):
                linked.add((i, j))
    assert linked and linked <= got <= want


def test_jaccard_blocks(spark, monkeypatch):
    """Leaders with many sets are dealt out by pairs of blocks, some labels with blocks of their own."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    rng, rows = np.random.default_rng(3), []
    base = prose(60, 30).split()
    for i in range(60):
        copy = list(base)
        for j in rng.choice(60, rng.integers(0, 8), replace=False):
            copy[j] = f"w{i}_{j}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(prose(40, 31).split()[: 20 + i])) for i in range(20)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 70)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 4, 70)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def brute_substring(rows, width):
    rows = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in rows for i in range(len(w) - width + 1))
    want = Counter()
    for d, w in rows:
        dead = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                dead[i : i + width] = [True] * width
        kept = b" ".join(x for x, y in zip(w, dead, strict=True) if not y)
        want[d, len(w), sum(dead), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    return want


@pytest.mark.parametrize("width", [3, 35])
def test_substring(docs, width):
    want = brute_substring(corpus(), width)
    got = substring.substring_dedup(docs, width, keep_text=True)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got.collect()) == want
    plain = substring.substring_dedup(docs, width)
    assert Counter(tuple(r) for r in plain.drop("factors").collect()) == Counter(k[:4] for k in want.elements())


def test_substring_overlaps(spark):
    """Passages cut at any place, periodic texts, and passages that meet or overlap."""
    rng, passage = np.random.default_rng(11), prose(200, 60).split()
    rows = [(i, " ".join([*prose(8, 200 + i).split(), *passage[a : a + n], *prose(5, 300 + i).split()])) for i, (a, n) in enumerate(zip(rng.integers(0, 150, 25), rng.integers(20, 80, 25), strict=True))]
    rows += [(50, "a b c " * 40), (51, "b c a " * 15), (52, "z " * 100), (53, " ".join(passage[:60] + passage[20:90])), (54, "z " * 34)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 35)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(k[:4] for k in brute_substring(rows, 35).elements())


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
CASES = [
    "mail a.b@c.de, x@y, @z.com, p@q.r_s@t.uv and é@x.y", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 0300.1.1.1 01.002.0003.255", "4539 1488 0343 6467 and 4539148803436468, 1-2-3",
    "+1 (377) 555-0271 +49-30 +12345678901234567 +1234567890+1234567890", "card 378282246310005 7 8", "9" * 3000, "", None, "IBAN DE89 3704 0044 0532 0130 00 tel 212-555-0100",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    want = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                want.append((m.start(), k, m.end()))
    assert [(s, k, e) for s, k, e, _ in pii.find(text) if k < 4] == sorted(want)


def test_pii_query(spark):
    """Counts, digests and spans of the query from plain regular expressions."""
    cases = [*CASES, "é a@b.cd 😀 +12345678901 1.2.3.4 a@b.cd"]
    rows = queries.digested(pii.personal_data(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"))).collect()
    for r in rows:
        text = cases[r["doc_id"]] or ""
        spans = []
        for k, p in enumerate(BASE):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                if [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                    spans.append((m.start(), k, m.end()))
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in pii.KINDS[:4]] == named
    assert len(rows) == len(cases)


def test_added_spans():
    kinds = [pii.KINDS[k] for _, k, _, _ in pii.find(CASES[-1])]
    assert "iban" in kinds and "local_phone" in kinds
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert not any(k == 5 for _, k, _, _ in pii.find("order 212-555-0100"))


@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO9386011117947", "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S"])
def test_iban_end(iban):
    """Upper-case words, numbers or another IBAN behind do not hide it."""
    for behind in ("", " EUR 500", " BIC COBADEFFXXX", " 500", " and 1", ", X", " DE89370400440532013000", " A" * 40):
        for before in ("", "IBAN ", "FROM AB12 ", "\u00e9 "):
            text = before + iban + behind
            got = [(s, e) for s, k, e, _ in pii.find(text) if k == 4]
            assert got[0] == (len(before), len(before) + len(iban)) and len(got) == 1 + ("DE89" in behind)
    assert not [k for _, k, _, _ in pii.find(f"{iban}0 EUR") + pii.find(f"{iban}x") + pii.find(f"A{iban}") if k == 4]


def test_toxicity(spark):
    bad = ["vile", "nasty", "rotten", "awful"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = prose(60, 100 + i), i % 5 == 0
        if toxic:
            parts = text.split()
            for j in range(0, 60, 6):
                parts[j] = bad[(i + j) % 4] + "word"
            text = " ".join(parts)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None), (9999, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int"))
    out = toxicity.scored(docs, model).withColumn("held", toxicity.held_out()).collect()
    known = dict(labels)
    held = [r for r in out if r["held"] and r["doc_id"] in known]
    assert len(held) > 100 and np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and all(r["predicted"] == 0 for r in out if not r["text"])


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 5).collect()
    sized = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows") for i, t in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in rows) == sized
    assert len(rows) == len(corpus())
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    m = sharding.communication_matrix([10, 0, 25, 7], 4, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 25, 7] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    mean = np.mean([sharding.communication_matrix([8, 8], 2, s)[0, 0] for s in range(300)])
    assert 3.6 < mean < 4.4


def test_decontamination(spark):
    item = prose(40, 50)
    w = item.split()
    edited = " ".join(w[:20] + ["zz"] + w[21:])
    texts = [f"{prose(50, 51)} {item} {prose(50, 52)}", f"{prose(9, 53)} {edited.upper()}!", item, prose(200, 54), " ".join(w[:15]), None, "", item]
    docs = spark.createDataFrame([(i if i else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, similarity int")
    items = spark.createDataFrame([(1, item), (2, "tiny"), (3, None), (4, "")], "item_id long, text string")
    n, found = 5, set()
    for i, t in enumerate(texts):
        g = decontam.shingles_of(decontam.words_of(t), n)
        s = np.sort(decontam.shingles_of(decontam.words_of(item), n))
        best = max((decontam.weighted_jaccard(np.sort(g[k : k + 36]), s) for k in range(max(1, len(g) - 35))), default=0)
        if len(g) and best >= 0.7:
            found.add(i if i else None)
    got = decontam.contaminated(docs, items, 5, 0.7).collect()
    assert {r["doc_id"] for r in got} == found and {None, 1, 2, 7} <= found
    assert {r["doc_id"] for r in decontam.decontaminate(docs, items, 5, 0.7).collect()} == {3, 4, 5, 6}


@pytest.mark.parametrize("minimum", [0, 3])
def test_warc(spark, minimum):
    rows = [(1, "http://a/é", "same"), (2, "u", "same"), (3, "u", "x"), (4, None, "x"), (5, "u", None), (6, "u", ""), (7, "u", "ünï" * 500_000), (2, "u", "same"), (None, "u", "same"), (None, "v", "lone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages, minimum).collect()
    groups = {}
    for p, _, h in rows:
        groups.setdefault(h or "", []).append(p)
    want = Counter()
    for h, ids in groups.items():
        body = h.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids = sorted(ids, key=lambda i: -1 if i is None else i)
        for k, p in enumerate(ids):
            response = len(body) < minimum or k == len(ids) - 1
            want[p, len(body), digest, "response" if response else "revisit", None if response else ids[-1]] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_bundle(tmp_path):
    writer = warc.BundleWriter(open(tmp_path / "b", "wb"))
    records = [os.urandom(n) for n in (10, warc.FRAME_BYTES + 5, 20, 30)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = warc.BundleReader(warc.pafs.LocalFileSystem().open_input_file(str(tmp_path / "b")))
    for (frame, offset), r in zip(places, records, strict=True):
        assert reader.frame(frame)[offset : offset + len(r)] == r


def test_lines(spark):
    rows = [(d, t) for d, t in corpus() if d is not None and t is not None]
    rows = list({d: (d, t) for d, t in rows}.values()) + [(500, "b\n c\nd"), (501, "b\nc"), (502, None)]
    seen, want = set(), {}
    for d, t in sorted(rows):
        ls = (t or "").split("\n")
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(ls) if x.strip(" \t\r")]
        dead = set()
        for p in range(len(full) - 2):
            k = tuple(x for _, x in full[p : p + 3])
            if k in seen:
                dead |= {i for i, _ in full[p : p + 3]}
            seen.add(k)
        kept = "\n".join(x for i, x in enumerate(ls) if i not in dead)
        want[d] = (len(ls), len(dead), kept)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, p int").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in lines.line_dedup(df, 3, keep_text=True, heavy=20).collect()}
    assert got == want


@pytest.mark.parametrize("heavy", [1, 10, 1000])
def test_line_runs(spark, heavy):
    """Runs go on through several places, end where the earlier text differs, and name the first place of each window."""
    block = [f"line {i}" for i in range(12)]
    rows = [
        (1, "\n".join(block)),
        (2, "\n".join(["new", *block[2:9], "", *block[9:11], "other"])),
        (3, "\n".join([*block[:4], "cut", *block[4:8], *block[1:5]])),
        (4, "\n".join(["new", *block[2:5], "a", "a", "a", "a", "a"])),
        (5, None),
        (None, "a\na\na"),
    ]
    first, want = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        full = [x.strip() for x in (t or "").split("\n") if x.strip()]
        runs: list[list] = []
        for p in range(len(full) - 2):
            of, start = first.setdefault(tuple(full[p : p + 3]), (d, p))
            if (of, start) == (d, p):
                continue
            last = runs[-1] if runs else None
            if last and last[2] == of and last[0] + last[1] == p + 2 and last[3] - last[0] == start - p:
                last[1] += 1
            else:
                runs.append([p, 3, of, start])
        want[d] = [tuple(r) for r in runs]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in lines.line_dedup(df, 3, keep_runs=True, heavy=heavy).collect()}
    assert got == want
    assert want[2] == [(1, 9, 1, 2)] and len(want[3]) == 3


@pytest.mark.parametrize("run", [1, 2])
def test_short_runs(spark, run):
    """A repeated line, or pair, between fresh lines goes; rows of fewer lines are compared too."""
    rows = [(1, "once\nsame\npair a\npair b\nend"), (2, "same"), (3, "new\n same \nother\n\n"), (4, "x\npair a\n\npair b\ny"), (5, None), (6, "same\nsame")]
    seen, want = set(), {}
    for d, t in rows:
        ls = (t or "").split("\n")
        full = [(i, x.strip()) for i, x in enumerate(ls) if x.strip()]
        dead = set()
        for p in range(len(full) - run + 1):
            k = tuple(x for _, x in full[p : p + run])
            if k in seen:
                dead |= {i for i, _ in full[p : p + run]}
            seen.add(k)
        want[d] = (len(ls), len(dead), "\n".join(x for i, x in enumerate(ls) if i not in dead))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in lines.line_dedup(df, run, keep_text=True, heavy=2).collect()}
    assert got == want


def test_single_lines_query(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(queries.SQL["op9_line_dedup_single"])
    got = queries.QUERIES["op9_line_dedup_single"](spark, data).select(*want.columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(docs, keep):
    got = exact.exact_dedup(docs, keep).collect()
    groups = {}
    for d, t in corpus():
        groups.setdefault(t or "", []).append(d)
    f = max if keep == "largest" else min
    for t, ids in groups.items():
        digest = hashlib.sha256(t.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == digest]
        top = f((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r["keep_id"] for r in mine} == {top} and {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [top]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_runs(spark, keep):
    """A group that crosses splitters and batches; rows are not joined by digest after their sort."""
    rows = [(i, "hot" if i % 3 else f"t{i // 30}") for i in range(60_000)] + [(None, "hot"), (None, "lone"), (5, "hot"), (5, "hot")]
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        out = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    groups, f = {}, max if keep == "largest" else min
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    want = Counter()
    for t, ids in groups.items():
        top = f((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        want.update((d, top, len(ids), digest) for d in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        out = p.store.written(stage(spark, docs, data), "test")
        assert out.columns == columns and 0 < out.count() <= before
        if name.startswith("exact"):
            assert out.select("text").distinct().count() == out.count()
        if name.startswith("n-gram"):
            left = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert len({c for _, _, c in brute_components(left, 5, 80)}) == len(left)
        docs, before = out, out.count()
    assert p.run(spark, data).select("doc_id").distinct().count() == before


def test_large_hypergeometric():
    """One sampler for every size: exact sums, and the law of small and of very large populations."""
    rng = np.random.default_rng(2)
    rows = [3 * 10**9, 10**9 + 7, 5, 0]
    m = sharding.communication_matrix(rows, 24, 3)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    for good, bad, n in ((5, 7, 6), (400, 100, 450), (10**6, 10**8, 5000), (10**12, 3 * 10**12, 10**6)):
        draws = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
        p, total = good / (good + bad), good + bad
        deviation = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
        assert abs(draws.mean() - n * p) < 4 * deviation / 3000**0.5 and 0.93 < draws.std() / deviation < 1.07
        assert draws.min() >= max(0, n - bad) and draws.max() <= min(good, n)


def test_same_ids(spark):
    """Rows that share a doc_id, or have none, are judged by their own texts, in the operators and in the stages."""
    import corpus_pipeline as p

    item, clean, other = prose(40, 50), prose(60, 70), prose(60, 71)
    rows = [(1, item), (1, clean), (None, item), (None, clean), (3, other), (5, other + " more"), (5, prose(60, 72)), (6, None), (7, "")]
    names = "doc_id long, text string, score int, toxic int, side string, kept string, __id int, predicted int, similarity int"
    docs = spark.createDataFrame([(*r, 1, 1, "a", "b", 2, 3, 4) for r in rows], names).repartition(3)
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (2, "")], "item_id smallint, text string")
    got = decontam.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(r for r in rows if r[1] != item)
    assert Counter(r["doc_id"] for r in decontam.contaminated(docs, items).collect()) == {1: 2, None: 2}
    near = p.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in near.collect())
    assert left == Counter([(1, item), (1, clean), (3, other), (5, rows[6][1]), (6, None), (7, "")])
    copies = Counter((r["doc_id"], r["text"]) for r in p.drop_copies(spark, docs, "").collect())
    assert copies == Counter([(1, item), (1, clean), *rows[4:8]])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.clean(docs, model, 1.1).count() == len(rows) and toxicity.scored(docs, model).count() == len(rows)
    for stage in (p.drop_near_copies, p.drop_copies):
        assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("page", ["", "a b", "x\r\nX-Page-ID: 7", None, "ü%"])
def test_page_ids(spark, page):
    rows = [(page, "http://a", "one"), ("z", "http://b", "one"), (page, "http://c", None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["payload_bytes"]) in (
        Counter([(page, "revisit", "z", 3), ("z", "response", None, 3)]), Counter([(page, "response", None, 3), ("z", "revisit", page, 3)]),
    )
    assert [(r["page_id"], r["record_type"]) for r in got if not r["payload_bytes"]] == [(page, "response")]


def test_many_lines(spark):
    """Half a million repeated lines in one text."""
    text = "\n".join(["same line"] * 500_000 + ["end"])
    got = lines.line_dedup(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), run=1).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got} == {1: (500_001, 499_999), 2: (1, 0)}


def test_decontamination_recall(spark):
    """Every edited item of weighted similarity 0.8 or more is found, with its similarity, place and length, against all windows."""
    rng, pairs = np.random.default_rng(9), []
    items = [(k, prose(int(rng.integers(9, 100)), 500 + k)) for k in range(40)]
    for k, item in items:
        for _ in range(4):
            w = item.split()
            for at in rng.choice(len(w), rng.integers(0, 1 + len(w) // 20), replace=False):
                w[at] = "edited"
            pairs.append((len(pairs), f"{prose(20, 700 + len(pairs))} {' '.join(w)} {prose(15, 900 + len(pairs))}", k))
    docs = spark.createDataFrame([p[:2] for p in pairs], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    sought = 0
    for doc, text, _ in pairs:
        for k, item in items:
            ids, own = decontam.words_of(text), decontam.words_of(item)
            a, b = decontam.shingles_of(ids, 5), np.sort(decontam.shingles_of(own, 5))
            every = [decontam.weighted_jaccard(np.sort(a[s : s + len(b)]), b) for s in range(len(ids) - len(own) + 1)] if len(np.intersect1d(a, b)) else [0.0]
            if max(every) >= 0.8:
                sought += 1
                r = got.pop((doc, k))
                assert r["similarity"] == max(every) and r["first_word"] == int(np.argmax(every)) and r["words"] == len(own)
    assert sought > 60 and not got
