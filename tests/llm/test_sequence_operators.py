"""Conversation repair, conversation trie and token records against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import conversation_repair as repair
from dossier.llm import conversation_trie as trie
from dossier.llm import token_records as records
from dossier.session import new_path

CONVERSATIONS = "conv_id long, turn long, role string, text string, fault string, place long, chunk int, h long, id long"
SPACES = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks(spark):
    """Odd conversations, with extra columns whose names the operators use themselves."""
    pick = random.Random(5)
    rows = [(None, 1, "user", "no id."), (None, None, None, None), (100, None, None, None), (101, 1, "system", "only")]
    rows += [(200, t, "user", "same.") for t in (None, None, 3, 3)]
    for conv in [*range(300, 340), 400, 401, 463]:
        said = [pick.choice(["Yes.", "No", "", " \t", "Why?", "x\ny!"]) for _ in range(pick.randrange(1, 9))]
        roles = [pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) for _ in said]
        rows += [(conv, pick.choice([None, i, i, 2 * i]), r, t) for i, (r, t) in enumerate(zip(roles, said))]
    rows += [(500, i, ("user", "assistant")[i % 2], f"Turn {i % 37}{'.' * (i % 5 > 0)}") for i in range(900)]
    rows += [(conv, t, *r) for conv in range(600, 640) for t, r in enumerate([("user", "Hi."), ("assistant", "Hello.")])]
    return spark.createDataFrame([(*r, "f", 1, 2, 3, 4) for r in rows], CONVERSATIONS)


def cheapest(rows):
    """Least cost and least audit by trying every edit, longest costs first left out (Dijkstra)."""
    import heapq

    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        state = said if len(said) < 2 else said[-1]  # an s is only ever first
        if (i, state) in seen:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        seen.add((i, state))
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in nexts.replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, role))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if fault != "d":
                more = 3 * (fault == "t")
                if role in nexts:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role))
                for other in nexts.replace("s", ""):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, other))


def test_unrolled_choices_are_the_cheapest_and_least():
    pick = random.Random(3)
    cases = [list(c) for n in range(4) for c in itertools.product(["sn", "un", "an", "od", "ut"], repeat=n)]
    for _ in range(300):
        some = [pick.choice("suao") + pick.choice("nndt") for _ in range(pick.randrange(1, 12))]
        cases.append([s for s in some for _ in range(pick.choice([1, 1, 2, 5]))])
    for case in cases:
        letters, _, state, cost = repair.unroll("".join(case), None, 0)
        assert state in (0, 1, 2, 3) and (cost, "".join(letters)) == cheapest([tuple(c) for c in case]), case


def test_chunks_give_the_choices_of_the_whole():
    pick = random.Random(4)
    symbols = ["un", "an"] * 5 + ["ut"] * 70 + [pick.choice("suao") + pick.choice("nndt") for _ in range(60)]
    whole = repair.unroll("".join(symbols), None, 0)
    cuts = [0, 3, 30, 80, 81, len(symbols)]
    parts = ["".join(symbols[a:b]) for a, b in zip(cuts, cuts[1:])]
    behind = [None]
    for part in parts[:0:-1]:
        value = repair._before(repair.chunk_matrix(part), behind[-1] or repair._END)
        behind.append(tuple(v - min(value) for v in value))
    letters, state = [], 0
    for part, value in zip(parts, reversed(behind)):
        found, _, state, _ = repair.unroll(part, value, state)
        letters += found
    assert letters == whole[0]


def written(value):
    return " " if value is None else str(value)


def brute_repair(rows):
    """Result rows of op11 by conversation; ``rows``: (conv_id, turn, role, text, hash of text)."""
    talks = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        talks[conv]
        kind = zlib.crc32(f"{written(conv)}:{written(turn)}".encode()) % 20
        text = {1: "", 2: written(text).translate(str.maketrans("", "", ".!?"))}.get(kind, written(text))
        role = "user" if kind == 4 else written(role)
        talks[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return talks


def test_repair_equals_brute_force(spark, talks):
    given = talks.select("conv_id", "turn", "role", "text")
    hashes = dict(talks.select(F.coalesce("text", F.lit(" ")), F.xxhash64(F.coalesce("text", F.lit(" ")))).distinct().collect())
    damaged = repair.damaged(talks)
    hashes |= {r.text: r.h for r in damaged.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = {}
    for conv, rows in brute_repair([(*r, 0) for r in given.collect()]).items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))
        turns = [t for t, _, _ in rows if t is not None]
        seen, symbols, faults = set(), [], collections.Counter()
        for _, role, text in rows:
            body = text.rstrip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            symbols.append((role[:1] or "o", {"": "n", "truncated": "t"}.get(fault, "d")))
        cost, audit = cheapest(symbols)
        said, left, state = [], list(rows), ""
        for letter in audit:
            role, text = (left.pop(0)[1:] if letter != "I" else ("", ""))
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            said.append(f"{role}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        counts = [faults[f] for f in ("blank", "duplicate", "truncated")]
        want[conv] = (conv, gaps, *counts, illegal, cost, audit, sha("\n".join(said)))
    for partitions in (1, 40):  # one chunk for each conversation, then many
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = {r.conv_id: tuple(r) for r in repair.repair_digests(damaged, given).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want
    nothing = given.filter(F.lit(False))
    assert repair.repair_digests(repair.damaged(nothing), nothing).count() == 0


def brute_trie(rows, hashes):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn, role or "", text or ""))
    for said in talks.values():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))
    nodes = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for conv, said in sorted(talks.items()):
        h = zlib.crc32(str(conv).encode()) % 6
        path = tuple((r, t) for _, r, t in talks.get(conv - conv % 100, [])[:h] + said[h:])
        ends[path].append(conv)
        for d in range(len(path) + 1):
            nodes[path[:d]].append(conv)
    below = collections.defaultdict(list)
    for path in nodes:
        if path:
            below[path[:-1]].append(path)

    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[p] for p in below[path])
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(below[p]), leaves[p], saved[p], sha(",".join(map(str, ends.get(p, [])))))
        for p, m in nodes.items()
    )


@pytest.mark.parametrize("size, least", [(400_000, 32), (20, 2), (1, 1)])
def test_trie_equals_brute_force(spark, talks, monkeypatch, size, least):
    monkeypatch.setattr(trie, "SHARD_TURNS", size)
    monkeypatch.setattr(trie, "SHARD_PATHS", least)
    hashes = dict(talks.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect())
    want = brute_trie([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()], hashes)
    got = sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in trie.conversation_trie(talks).collect())
    assert got == want
    assert trie.conversation_trie(talks.filter(F.lit(False))).count() == 0


def test_medians_come_first():
    assert list(trie.medians_first(7)) == [3, 1, 5, 0, 2, 4, 6] and sorted(trie.medians_first(100)) == list(range(100))
    tree = trie.Tree()
    for i in trie.medians_first(1023):
        tree.insert([i], [1])
    at, depth = tree.child[0], 0
    while at:
        at, depth = tree.more[at], depth + 1
    assert depth == 10


def test_checksums_equal_the_published_ones():
    sums = records.Checksums()

    def slow(data):
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
        state ^= 0xFFFFFFFF
        return ((state >> 15 | state << 17) + 0xA282EAD8) & 0xFFFFFFFF

    assert slow(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    pick = random.Random(1)
    parts = [pick.randbytes(n) for n in [*range(4, 40), 1000, 4097]]
    assert sums.of(parts).tolist() == [slow(p) for p in parts] and len(sums.of([])) == 0


PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b   c ", "x \n y\n z \t", "<|endoftext|> a <|endoftext|>", "a  <|endoftext|>  b", "it's  'tis", "日本 語 🙂", "é   b", "q" * 9000, " " * 50, "a  b ᠎ c", "x ​ y", "end "]


@pytest.mark.parametrize("files", [1, 5])
def test_records_equal_the_library(spark, documents, odd, nothing, files):
    library = Tokenizer.from_file(PATH)
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    texts = documents.select("doc_id", "text").unionByName(extra).unionByName(odd.selectExpr("doc_id - 100 AS doc_id", "text"))
    path = new_path(spark)
    records.write_records(texts, path, PATH, 2, files=files)
    want = collections.defaultdict(list)
    for r in texts.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id].append(np.array(ids, "<u4").tobytes())
    read = records.read_records(spark, path)
    found = collections.defaultdict(list)
    for r in read.collect():
        found[r.id].append(bytes(r.ids))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    rows = sorted(records.record_digests(read).collect(), key=lambda r: r.start)
    ids = [r.id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and rows[0].start == 0
    assert [a.start + a.n_tokens for a in rows[:-1]] == [b.start for b in rows[1:]]
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(v) for vs in want.values() for v in vs)
    shuffled = records.read_records(spark, path, seed=3).collect()
    assert sorted(map(tuple, shuffled)) == sorted(map(tuple, read.collect())) and shuffled != read.collect()
    empty = new_path(spark)
    records.write_records(nothing, empty, PATH, 2)
    assert records.record_digests(records.read_records(spark, empty)).count() == 0


def test_damage_is_found_and_stray_files_are_not_read(spark, documents):
    path = new_path(spark)
    records.write_records(documents, path, PATH, 2, files=2)
    system, root = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_output_stream(f"{root}/data/part-00000-left-by-a-lost-task.rec") as out:
        out.write(b"junk")
    assert records.read_records(spark, path).count() == documents.count()
    name = records.read_index(spark, path).select("name").first()[0]
    with system.open_input_file(f"{root}/data/{name}") as f:
        data = bytearray(f.read())
    data[60] ^= 1
    with system.open_output_stream(f"{root}/data/{name}") as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, path).count()


def test_frames_follow_each_other(spark, documents):
    """A reader that knows only the frame reads a file from start to end."""
    path = new_path(spark)
    records.write_records(documents, path, PATH, 2, files=1)
    rows = records.read_index(spark, path).orderBy("record").collect()
    system, root = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{root}/data/{rows[0].name}") as f:
        data = f.read()
    at = 0
    for r in rows:
        assert r.offset == at
        at += 16 + int.from_bytes(data[at : at + 8], "little")
    assert at == len(data)


def test_nested_headers_take_linear_time(spark, tmp_path):
    """A page full of record headers that each claim the rest of the page."""
    import time

    from dossier.llm import warc

    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n"
    pages = [(1, "u", "".join(head.format(i, 10**7) for i in range(16_000))), (2, "v", "plain")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "300k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            began = time.time()
            got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
            assert time.time() - began < 60
            assert {k: (r.payload_bytes, r.digest_ok) for k, r in got.items()} == {"urn:page:1": (len(pages[0][2]), True), "urn:page:2": (5, True)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_documents_of_repeated_words(spark):
    """Time and rows stay in proportion to the text; results equal the definition."""
    import time

    from dossier.llm import decontamination as D

    items = spark.createDataFrame([(1, "the"), (2, "na " * 30), (3, "of the"), (4, "one two three four five")], "item_id long, text string")
    long_one = ("na " * 40_000) + " ".join(f"w{i % 50} the" for i in range(80_000)) + " one two x four five"
    texts = [(1, long_one), (2, "na na na"), (3, "all of the"), (4, None), (5, "one two three four five")] + [(5, "the end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): (r.doc_start, r.n_tokens, r.n_equal) for r in D.contaminated(docs, items).collect()}
    assert time.time() - began < 90
    assert got == {
        (1, 1): (40_001, 1, 1), (1, 2): (0, 13, 13), (1, 4): (200_000, 5, 4), (3, 1): (2, 1, 1),
        (3, 3): (1, 2, 2), (5, 4): (0, 5, 5), (5, 1): (0, 1, 1),
    }


def test_context_tells_more_than_word_frequencies(spark):
    """The trained network beats the frequencies of the words, from which it starts."""
    from dossier.llm import lm_scoring as L

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [L.text_words(r.text) for r in docs.select("text").collect()]
    counts = collections.Counter(w for t in texts for w in t)
    total = sum(counts.values())
    frequencies = sum(n * np.log(n / total) for n in counts.values()) / total

    def mean(rounds):
        found = L.score_documents(docs, rounds=rounds).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
        assert found[1] == total
        return found[0] / total

    untrained, trained = mean(0), mean(L.ROUNDS)
    assert abs(untrained - frequencies) < 0.05 and trained - frequencies > 0.15


def test_letters_and_their_signs_skip_the_pre_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        pieces, whole = records.Pieces(Tokenizer.from_str(f.read()), "<u2"), Tokenizer.from_file(path)
    plain = "Wort wort, größe. ÉTÉ!? ñandú.\nOtra Ende.%%%\nNeu, a\nb ßß:-) жар;"
    odd = [
        "don't can't. it's's 'quote' x'. x'\n", "a.\n\nb a\n b a \nb a.\r\nb \n a\n", "x1 1x ab12. a_b _a a.b a-b\nc ", "a<|endoftext|> b <|endoftext|>. a.<|endoftext|>",
        "  two  spaces ", "汉 漢字。 字.\n字 a", "\u00aab \u2126 e\u0301 \u0905\u093f \u01c5 \u00b2 \u2160 \u200bz z\u00ad. \u00a0n\u00a0m", "w" * 70 + " " + "v" * 70 + ". " + "ab" + "!" * 80, "", None,
    ]
    want = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes() for t in (plain, *odd)]
    for _ in range(2):
        assert pieces.coded([plain, *odd], b"\2\0") == want
    pieces.clear()
    asked, ids = [], pieces.ids
    pieces.ids = lambda text: asked.append(text) or ids(text)
    pieces.coded([plain], b"")
    assert not [t for t in asked if any(c.isalpha() for c in t)]
