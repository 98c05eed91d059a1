"""Decontamination, near-duplicates, secrets, packing and the pipeline, by brute force."""

import collections
import hashlib
import random
import re
import string
import time
import zlib
from array import array

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from jobspark.llm import common, decontamination, packing, queries, secret_scan, simhash_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "ne", "sol") for b in ("", "na", "mer", "tis", "lo", "gan")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


# ---- SimHash -----------------------------------------------------------------------------

def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_groups(fps, radius=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints_and_groups_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    for t in texts[:25]:  # near copies of near copies
        for _ in range(rng.randint(1, 4)):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
            texts.append(t)
    texts += [None, "", " \t\n", "ÄÖ İx   a\x1cb", texts[3].upper(), texts[3], texts[3]]
    got = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(
        frame(spark, texts, fp="x", least=1, node="y", key="z")).collect()}
    fps = [simple_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == simple_groups(fps)
    assert [fps[i] for i in range(-7, -4)] == [0, 0, 0]


@pytest.mark.parametrize("n", [5, 400])
def test_links_of_dense_and_chained_fingerprints(spark, n):
    """Small and large groups that meet: balls around one value, and a chain of steps."""
    rng = random.Random(n)
    center = rng.getrandbits(64)
    fps = {center} | {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(n)}
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = {r["node"]: r["component"] for r in common.components(simhash_dedup.links(df)).collect()}
    want = simple_groups(fps)
    for i in range(len(fps)):
        for j in range(i):
            a, b = found.get(signed[i], signed[i]), found.get(signed[j], signed[j])
            assert (a == b) == (want[i] == want[j])


def test_large_groups_parted_by_blocks_lose_no_link(monkeypatch):
    """Mostly far apart, pairs, a chain and a ball, all in one group that meets."""
    rng = random.Random(8)

    def changed(x, n):
        return x ^ sum(1 << b for b in rng.sample(range(64), n))

    fps = {rng.getrandbits(64) for _ in range(900)}
    fps |= {changed(x, rng.randint(1, 5)) for x in rng.sample(sorted(fps), 60)}
    ball = rng.getrandbits(64)
    fps |= {changed(ball, rng.randint(1, 6)) for _ in range(200)}
    for _ in range(15):
        ball = changed(ball, 4)
        fps.add(ball)
    fps = sorted(fps)
    monkeypatch.setattr(simhash_dedup, "LARGE", 512)
    keys = np.zeros(len(fps), np.int64)
    batch = simhash_dedup._links(keys, np.array(fps, np.uint64).view(np.int64))
    place = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))
    for a, b in zip(*(c.to_numpy().view(np.uint64).tolist() for c in batch.columns)):
        assert (a ^ b).bit_count() <= 4
        i, j = sorted((label[place[a]], label[place[b]]))
        label = [i if x == j else x for x in label]
    assert label == simple_groups(fps)


def test_near_duplicates_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_dedup.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame(
        [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, None)], "doc_id bigint, text string")
    got = sorted(simhash_dedup.near_duplicates(odd).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != 9] == [(7, 7), (7, 7), (None, 7)]
    kept = simhash_dedup.keep_first(odd.withColumn("component_id", F.lit("x"))).collect()
    assert sorted(r["doc_id"] for r in kept) == [7, 9]
    assert kept[0].__fields__ == ["doc_id", "text", "component_id"]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(common.components(df).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


# ---- decontamination ---------------------------------------------------------------------

def bag(text):
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]


def simple_matches(docs, items):
    out = {}
    for d, text in enumerate(docs):
        every = bag(text)
        for k, item in enumerate(items):
            want = bag(item)
            count, best = collections.Counter(want), 0
            at = [i for i, s in enumerate(every) if s in count]
            for i in at:
                inside = [j for j in at if i <= j < i + len(want)]
                window = every[i:inside[-1] + 1]
                m = sum((collections.Counter(window) & count).values())
                best = max(best, m / (len(window) + len(want) - m))
            if best >= 0.8 - 1e-9:
                out[d, k] = round(best, 6)
    return out


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (5, 9, 12, 20, 33, 60, 90)] + ["ko " * 12, "too short", "", None]
    items.append(items[4] + " " + prose(rng, 4))  # holds another item
    items.append(items[3])
    docs = []
    for item in items[:8]:
        w = item.split()
        docs.append(prose(rng, 30) + " " + item.upper().replace(" ", ", ") + ". " + prose(rng, 30))
        for at in (0, 1, len(w) // 2, len(w) - 1):
            docs.append(prose(rng, 8) + " " + " ".join(w[:at] + ["edited"] + w[at + 1:]) + " " + prose(rng, 5))
        docs.append(" ".join(w[2:] + w[:2]))
        docs.append(" ".join(w[: int(len(w) * 0.85)]))
    docs += [items[5] + " " + items[6] + " " + items[4], items[11], None, "", "a b", prose(rng, 3000) + " " + items[3]]
    frame_items = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.matches(frame(spark, docs, n="x", bits=1, zone=2, item="y"), frame_items)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == simple_matches(docs, items)


def test_matches_of_empty_tables_and_nulls(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (None, None)], "item_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert decontamination.matches(none, items).collect() == []
    docs = spark.createDataFrame(
        [(None, "x one two three four five six seven y"), (4, "one two THREE four five-six seven"), (4, "other")], "doc_id bigint, text string")
    got = {tuple(r) for r in decontamination.matches(docs, items).collect()}
    assert got == {(None, 1, 1.0), (4, 1, 1.0)}
    assert decontamination.matches(docs, items.filter("false")).collect() == []
    assert decontamination.remove_contaminated(docs, items).collect() == []
    assert decontamination.remove_contaminated(docs, items.filter("false")).count() == 3


def test_clean_rows_without_id_stay(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, "x one two three four five six seven y"), (None, "clean text"), (None, "clean text"),
                                  (None, None), (3, "one two three four five six seven"), (4, "other")], "doc_id bigint, text string")
    got = decontamination.remove_contaminated(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(None, "clean text"), (None, "clean text"), (None, None), (4, "other")], key=str)


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(7, a), (7, b), (7, b), (8, a), (9, c), (None, c), (None, prose(rng, 40)), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, simhash_dedup.keep_first(docs).collect()), key=str)
    assert got == sorted([(7, a), (7, b), (9, c), rows[6]], key=str)


def test_window_fingerprints_are_majorities(spark):
    rng = random.Random(2)
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 8, 55, 500)]
    df = spark.createDataFrame([(s,) for s in sets], "h array<bigint>")
    got = [r[0] for r in df.select(decontamination.simhash("h")).collect()]
    for hashes, fp in zip(sets, got):
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))
        assert fp % (1 << 64) == want


def test_decontamination_runs_no_python(spark):
    plan = queries.QUERIES["op1_decontamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_texts_are_cut_into_shingles_once(spark):
    sf = "/root/testdata/sf0.001"
    parts = common.checkpoint(decontamination.items(common.table(spark, sf, "benchmark", "item_id", "text")))
    found = decontamination.zones(common.table(spark, sf, "documents", "doc_id", "text"), parts, "doc_id", "text")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"subquery#\d+[^,]{0,20} AS bits", plan)  # no row carries the bitmap


def test_zones_stay_few_beside_many_items(spark):
    rng = random.Random(21)
    items = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(44)) for _ in range(20_000)]
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(3000)) for _ in range(30)]
    texts[7] += " " + items[11] + " x " + items[19_999] + " y"
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    parts = common.checkpoint(decontamination.items(benchmark))
    found = decontamination.zones(frame(spark, texts), parts, "doc_id", "text").collect()
    assert {r["id"] for r in found} == {7} and 80 <= sum(len(r["content"]) for r in found) < 100
    got = decontamination.matches(frame(spark, texts), benchmark)
    assert sorted(map(tuple, got.collect())) == [(7, 11, 1.0), (7, 19_999, 1.0)]
    assert decontamination.longs(1) == decontamination.BITMAP and decontamination.longs(10**12) == decontamination.LARGEST


# ---- secrets -----------------------------------------------------------------------------

def simple_base(text):
    out = []
    for kind, pattern, group, least in (
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    alphabet = ["password", "PassWD", "token", "api_key", "apiKEY", "secret", "=", ":", " ", '"', "'", "AKIA", "é😀",
                "ABCDEF0123456789", "0123456789abcdef", "abc", "x", ".", "ſecret", "K"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, ""]
    for row in secret_scan.scan(frame(spark, texts, found=1, spans="x")).collect():
        want = simple_base(texts[row["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(
            sum(k == kind for _, k, _ in want) for kind in secret_scan.KINDS)
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))


def test_novel_strings_in_sensitive_contexts():
    scanner = secret_scan.Scanner()
    key = "qX7pL2vN9sRt4WzK8mBc1YdF"
    text = f'headers = {{"Authorization": "Bearer {key}"}}'
    assert scanner.scan(text)[1] == [("novel", text.index(key), text.index(key) + len(key))]
    for calm in ("secret handshake of the your_api_key_here placeholder",
                 f"the colour {key} of the sky",  # no sensitive word
                 "authorization abcdefghijklmnopqrstuvwxyz0123456789abcdef",
                 f"{key} and {key} again. credential {key}"):  # known from the text around it
        assert scanner.scan(calm)[1] == []
    assert secret_scan.masked("ab token=123456 cd", [("assign", 3, 15), ("hex", 9, 15)]) == "ab [secret] cd"


def test_novel_strings_beside_letters_with_a_longer_lower_case():
    key = "qX7pL2vN9sRt4WzK8mBc1YdF"
    text = f"İİİ Authorization: BEARER {key}"
    assert secret_scan.Scanner().scan(text)[1] == [("novel", text.index(key), len(text))]


def test_long_digits_of_base_16_are_novel():
    rng = random.Random(3)
    for _ in range(20):
        key = "".join(rng.choice("0123456789ABCDEF") for _ in range(64))
        assert secret_scan.Scanner().scan(f"Authorization: Bearer {key}")[1] == [("novel", 22, 86)]
    assert secret_scan.Scanner().scan("token of " + "0123456789ABCDEF" * 4)[1] == []


def test_random_strings_of_any_length_and_alphabet_are_novel():
    rng, scanner = random.Random(9), secret_scan.Scanner()
    code = "".join(f"    self.value_{i} = config.get('setting{i}', default={i * 7})\n" for i in range(12))
    for around in ("", code, prose(rng, 80)):
        for chars in ("abcdefghijklmnopqrstuvwxyz0123456789", string.ascii_letters + string.digits + "+/", "0123456789ABCDEF"):
            for n in (32, 100, 400, 2000):
                missed = 0
                for _ in range(10):
                    key = "a1"[: 2 * (chars[0] == "a")] + "".join(rng.choice(chars) for _ in range(n))
                    text = f"{around}\nAuthorization: Bearer {key}\n{around}"
                    missed += key in secret_scan.masked(text, scanner.scan(text)[1])
                assert missed <= 1
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    lines = "\n".join(f"GET /{i} Authorization: Bearer {key}" for i in range(12))
    assert key not in secret_scan.masked(lines, scanner.scan(lines)[1])


def test_private_keys_are_masked_over_all_lines():
    rng, scanner = random.Random(10), secret_scan.Scanner()
    lines = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(20)] + ["+q3A=="]
    fixed = ["A" * 64, *lines[:2]]
    for some in (lines, fixed):
        for gap in ("\n", "\r\n", "\\n", '",\n  "'):
            text = gap.join(["a -----BEGIN RSA PRIVATE KEY-----", *some, "-----END RSA PRIVATE KEY----- b"])
            got = secret_scan.masked(text, scanner.scan(text)[1])
            assert not any(x in got for x in some) and got.endswith("-----END RSA PRIVATE KEY----- b")
    text = "\n".join(["the private key is", *lines, "and so on"])
    assert secret_scan.masked(text, scanner.scan(text)[1]) == "the private key is\n[secret]\nand so on"
    assert scanner.scan("private key:\nsome words\nin some lines\n")[1] == []


def test_long_repeated_context_is_linear():
    assert secret_scan.Scanner().scan("token " * 50_000)[0] == []


# ---- packing -----------------------------------------------------------------------------

def test_ids_equal_whole_texts():
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(5)
    parts = ["word", " word", "don't", "'s", "12", " ", "\n", "\t", "\r\n", ".", "…", "é", "中", "\0", "<|endoftext|>", " ", "  ", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, ids in zip(texts, packing.Encoder(queries.vocabulary()).encode(texts)):
        assert ids == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_ids_of_parts_equal_whole_texts():
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(11)
    signs = ["a", "B", "s", "t", "7", " ", " ", "\n", "\t", "'", ".", "!", "é", "ß", "×", "÷", "…", "ü", "\x85",
             "\u3000", "中", "😀", "\0", "<|endoftext|>", "-", "\"", "re", "\x7f", "\xa0"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 9))) for _ in range(30_000)] + ["", "x  ", "y", " ", "z\n", " q"]
    encoder = packing.Encoder(queries.vocabulary())
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_words_are_encoded_once_whatever_sign_follows(monkeypatch):
    encoder = packing.Encoder(queries.vocabulary())
    sent = []
    inner = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return inner.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counting()
    words = [f" stem{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    monkeypatch.setattr(packing, "TOGETHER", 1000)
    list(encoder.encode(["x" + "".join(w + sign for w in words) for sign in ("", ",", ".", "!!", ";", "\nEnd")]))
    assert sum(map(len, sent)) < 2.2 * sum(map(len, words))


def test_pieces_fill_sequences_without_gaps(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([1, 5, 80, 300, 900, 2500])) for _ in range(150)] + [None, "", prose(rng, 5)] * 3
    rows = packing.pack(frame(spark, texts, rank="x", length=3, id="y"), queries.vocabulary()).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = array("I", ids[at:at + r["length"]]).tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SIZE


def test_patterns_place_every_piece():
    rng = random.Random(7)
    for size in (16, 2048):
        histogram = {rng.randint(1, size): rng.randint(1, 10 ** 6) for _ in range(size // 2)}
        packs = packing.patterns(histogram, size)
        placed = collections.Counter()
        for count, pack in packs:
            assert sum(pack) <= size and count > 0
            for length in pack:
                placed[length] += count
        assert placed == histogram
        used = sum(k * v for k, v in histogram.items())
        assert used / (size * sum(c for c, _ in packs)) > 0.9
    assert packing.patterns({}) == []


def test_empty_table_packs_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), queries.vocabulary()).collect() == []


# ---- pipeline ----------------------------------------------------------------------------

def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    first = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    known, single, clean, masked, packed = (x.toPandas() for x in kept)
    assert len(known) > 0.98 * len(first)
    fps = [simple_fingerprint(t) for t in known.sort_values("doc_id").text]
    ids = sorted(known.doc_id)
    assert sorted(single.doc_id) == sorted({ids[g] for g in simple_groups(fps)})
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text.tolist()
    order = single.sort_values("doc_id")
    bad = {order.doc_id.iloc[d] for d, _ in simple_matches(order.text.tolist(), items)}
    assert set(clean.doc_id) == set(single.doc_id) - bad
    assert set(masked.doc_id) == set(clean.doc_id)
    assert not any(simple_base(t) for t in masked.text)
    assert (masked.text.str.len() == masked.n_chars).all()
    assert set(packed.doc_id) == set(masked.doc_id)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (None, "le la de un", "fr", "s", 11), (2, "", "en", "s", 0)]
    for k, some in enumerate(([], rows)):
        docs = spark.createDataFrame(some, SCHEMA).withColumn("score", F.lit("own"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.write.parquet(path := str(tmp_path / f"{k}{name}"))
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.read.parquet(path) if k else docs


def test_many_known_spans_beside_candidates():
    scanner = secret_scan.Scanner()
    line = "token=abcdef{0:05d} bearer Zq8vR2m{0:05d}Xw4Lp9T hex {1}\n"
    rng = random.Random(5)
    text = "".join(line.format(i, "%030x" % rng.getrandbits(120)) for i in range(8000))
    started = time.process_time()
    base, novel = scanner.scan(text)
    assert time.process_time() - started < 60  # every candidate against every span took minutes
    assert len([s for s in base if s[0] == "assign"]) == 8000
    spans = sorted((a, b) for _, a, b in base)
    assert not any(a < end and start < b for _, start, end in novel[:200] for a, b in spans)
