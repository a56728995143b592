"""Operators on texts against SQL, the published library or brute force."""

import collections
import hashlib
import itertools
import random
import time

import compare
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import bpe, chat_windows, decontamination, exact_dedup, jaccard_join
from dossier.llm import lm_scoring, quality_rules, registry, substring_dedup, token_counts, warc
from dossier.llm.words import text_words

registry.load()


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data_dir, name):
    con = compare.connect(data_dir)
    df = registry.QUERIES[name](spark, data_dir)
    cursor = con.execute(registry.ORACLES[name])
    got = compare.rows_of(df.columns, df.collect())
    assert got == compare.rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_exact_dedup_cases(odd, nothing):
    rows = [r for r in exact_dedup.mark_copies(odd).collect()]
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].keep_id == 2 and not by_id[1][0].kept and by_id[2][0].group_size == 2
    assert by_id[4][0].keep_id == 5 and by_id[4][0].group_size == 3
    assert sorted(r.kept for r in by_id[5]) == [False, True]
    assert by_id[8][0].kept is False and by_id[9][0].kept  # only A to Z are lower-cased
    stay = exact_dedup.drop_copies(odd)
    assert stay.columns == odd.columns and stay.count() == sum(r.kept for r in rows)
    assert exact_dedup.mark_copies(nothing).count() == exact_dedup.drop_copies(nothing).count() == 0


def test_a_full_filter_changes_nothing(documents):
    few = exact_dedup.mark_copies(documents, max_bits=1 << 16)
    most = exact_dedup.mark_copies(documents)
    assert sorted(few.collect()) == sorted(most.collect())


ODD_TEXTS = ["", " ", "a" * 3000, "<|endoftext|>x<|startoftext|> y", "ΑΣ Σ", "don't WE'RE 'S", "é ẛ̣ ﬁ ½ ² ٣", "日本語🙂👩‍👩‍👧", "\x00 \x1c\x85b", " \n\t x \r\n"]


def test_token_counts_equal_the_library(spark, documents, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    texts = documents.select("doc_id", "text").unionByName(extra).unionByName(odd.select("doc_id", "text"))
    want = sorted(
        (r.doc_id is None, r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024)
        for r in texts.collect()
    )
    for options in ({}, {"table_entries": 5, "table_documents": 1}):
        got = token_counts.count_tokens(texts, path, **options).collect()
        assert sorted((r.doc_id is None, *r) for r in got) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_bpe_equals_the_library(spark, documents, odd, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    texts = documents.select("doc_id", "text").unionByName(extra).unionByName(odd.filter("doc_id <> 5").selectExpr("doc_id + 2000000 AS doc_id", "text"))
    got = {r.doc_id: r for r in bpe.digest_codes(texts, path).collect()}
    whole = {r.doc_id: r for r in bpe.encode_texts(extra, path).collect()}
    for r in texts.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode()))
        assert tuple(got[r.doc_id])[1:] == want
        if r.doc_id in whole:
            assert (whole[r.doc_id].ids, whole[r.doc_id].decoded) == (ids, back)
    assert bpe.digest_codes(nothing, path).count() == 0


def test_substring_dedup_equals_brute_force(documents, odd, nothing):
    for df, k, m in ((documents, 50, 16), (odd, 50, 16), (documents, 8, 3)):
        rows = df.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, k=k, m=m).collect()}
        first = {}
        for r in rows:
            words = (r.text or "").encode().split()
            keep = np.ones(len(words), bool)
            for at in range(len(words) - k + 1):
                if first.setdefault(hashlib.md5(b" ".join(words[at : at + k])).digest(), r.doc_id) < r.doc_id:
                    keep[at : at + k] = False
            kept = b" ".join(w for w, stays in zip(words, keep) if stays)
            own = got[r.doc_id]
            assert (own.n_words, own.n_removed, own.kept_sha256) == (len(words), int((~keep).sum()), sha(kept))
            assert own.kept_text == kept.decode()
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_rows_that_share_an_id_keep_their_own_words(spark):
    words = [f"w{i}" for i in range(300)]
    said = " ".join(words)
    texts = [(1, said), (2, "short"), (2, "new " * 70 + said), (2, " ".join(words[::-1])), (2, said), (2, None)]
    texts += [(3, "other " + " ".join(words[40:200]) + " end"), (3, said[:40])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = collections.Counter(tuple(r) for r in substring_dedup.remove_repeats(df).collect())
    want = [(1, 300, 0, said), (2, 1, 0, "short"), (2, 370, 300, " ".join(["new"] * 70)), (2, 300, 0, " ".join(words[::-1]))]
    want += [(2, 300, 300, ""), (2, 0, 0, ""), (3, 162, 160, "other end"), (3, len(said[:40].split()), 0, said[:40].strip())]
    assert rows == collections.Counter((i, n, gone, sha(kept.encode()), kept) for i, n, gone, kept in want)


def _groups(rows):
    """Links and groups by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().encode().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    holders, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            common.update((j, i) for j in holders[x])
            holders[x].append(i)
    links, root = collections.Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links.update((a, b))
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def test_jaccard_join_equals_brute_force(documents, nothing):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similar_documents(documents).collect()}
    assert got == _groups([(r.doc_id, r.text) for r in documents.collect()])
    assert jaccard_join.similar_documents(nothing).count() == 0


def test_dense_group_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 2_000)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # near copies of one text, all in one node
        words = list(base)
        for at in rng.integers(0, 120, 2):
            words[at] = f"new{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"r{rng.integers(0, 9999)}" for _ in range(60))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similar_documents(df).collect()}
    assert got == _groups(rows)
    assert {r.doc_id: r.class_id for r in jaccard_join.similar_documents(odd).collect()}[7] == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (200, 201)]
    rows = jaccard_join.least_members(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(1, 41)} | {100: 50, 75: 50, 201: 200}
    assert {r.node: r.root for r in rows} == want


def test_decontamination_tolerates_substitutions(spark, documents, odd, nothing, data_dir):
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    text = items.filter("length(text) > 150").orderBy("item_id").first()
    words = text.text.split()
    words[6] = words[17] = "changed"
    planted = [(10**6, "before it " + " ".join(words) + " after"), (10**6 + 1, " ".join(words[:8]))]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, items).collect()}
    assert (10**6, text.item_id) in got and not any(d == 10**6 + 1 for d, _ in got)
    whole = [(r.item_id, decontamination.tokens(r.text)) for r in items.collect()]
    need = set()
    for r in df.collect():
        own = decontamination.tokens(r.text)
        joined = b" ".join([b"", *own, b""])
        need |= {(r.doc_id, i) for i, w in whole if len(w) >= 12 and b" ".join([b"", *w, b""]) in joined}
    assert need <= got
    clean = decontamination.clean_documents(documents, items)
    assert clean.columns == documents.columns
    assert clean.count() == documents.count() - len({d for d, _ in got if d < 10**6})
    assert decontamination.contaminated(odd, items).count() == 0
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(odd, nothing.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_decontamination_equals_all_diagonals(spark):
    rng = np.random.default_rng(7)
    items = [[f"i{n}w{rng.integers(10**6)}" for _ in range(n)] for n in (*range(1, 15), 20) for _ in range(8)]
    items += [["見本の文"], []]
    texts = []
    for words in items:
        for rate in (0, 0.1, 0.15, 0.2):
            said = [f"s{rng.integers(10**6)}" if rng.random() < rate else w for w in words]
            texts.append(" ".join([*(f"a{rng.integers(99)}" for _ in range(rng.integers(5))), *said, "end"]))
    for gone in itertools.combinations(range(13), 2):  # every pattern of the shortest window
        texts.append(" ".join("x" if i in gone else w for i, w in enumerate(items[96])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontamination.contaminated(df, bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        own = np.array(text.split())
        for i, words in enumerate(items):
            n = min(13, len(words))
            if not set(words) & set(own):
                continue
            tried = [decontamination._overlap(own, np.array(words), at, n) for at in range(-len(words), len(own))]
            best = max((t[0] for t in tried if t), default=0)
            if best >= 0.8 * n:
                want[d, i] = best
    assert len(items[96]) == 13 and got == want


def test_quality_rules(spark, data_dir, documents, odd, nothing):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    model = quality_rules.learn(documents, labels)
    rows = quality_rules.score_quality(documents, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.9 * len(rows)
    assert model.weights and all(len(rule.tests) <= 3 for rule, _ in model.weights)
    for r in quality_rules.score_quality(odd, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert quality_rules.good_documents(odd, model).columns == odd.columns
    assert quality_rules.score_quality(nothing, model).count() == 0
    none = quality_rules.learn(documents, labels.filter(F.lit(False)))
    assert {r.score for r in quality_rules.score_quality(odd, none).collect()} == {0.5}


def test_repeated_ids_do_not_enlarge_the_sample(spark, data_dir, documents):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    assert quality_rules.learn(documents.unionByName(documents), labels) == quality_rules.learn(documents, labels)


def test_held_out_rows_are_not_learned_from(spark, data_dir, documents):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    other = labels.withColumn(
        "quality", F.when(quality_rules.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert quality_rules.learn(documents, labels) == quality_rules.learn(documents, other)


def test_lm_scores_equal_brute_force(spark, odd, nothing):
    rng = np.random.default_rng(1)
    net = lm_scoring.Network()
    ids, lengths = rng.integers(0, lm_scoring.VOCABULARY, 40), np.array([0, 1, 30, 9])
    contexts = lm_scoring.windows_of(ids, lengths)
    got = net.run(ids, contexts, learn=False)
    ends, p = np.cumsum(lengths), net.parts
    for i, token in enumerate(ids):
        doc = int(np.searchsorted(ends, i, "right"))
        low, high = ends[doc] - lengths[doc], ends[doc]
        total = p["bias"].astype(float)
        for place, o in enumerate((-2, -1, 1, 2)):
            near = ids[i + o] if low <= i + o < high else lm_scoring.VOCABULARY
            total = total + p["tables"][place][near]
        h, g, m = np.tanh(total), token % lm_scoring.GROUPS, token // lm_scoring.GROUPS
        a = h @ p["group"][:-1] + p["group"][-1]
        b = h @ p["inner"][g][:-1] + p["inner"][g][-1]
        want = a[g] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())
        assert abs(got[i] - want) < 1e-4
    rows = {r.doc_id: r for r in lm_scoring.score_documents(odd).collect()}
    assert rows[1].n_tokens == 0 and rows[1].log_prob == 0 and rows[1].mean_log_prob is None
    assert rows[6].n_tokens == 60_000 and rows[6].log_prob < 0
    assert lm_scoring.score_documents(nothing).count() == 0


def test_lm_takes_the_largest_logit_off_where_it_may_be_large():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, lm_scoring.VOCABULARY, 300)
    contexts = lm_scoring.windows_of(ids, np.array([300]))
    net = lm_scoring.Network()
    assert net._bounded() and np.isfinite(net.run(ids, contexts, learn=True)).all()
    small = net.run(ids, contexts, learn=False)
    net.parts["group"][-1] += 500  # a bias that all groups share changes nothing
    net.parts["inner"][:, -1] -= 500
    assert not net._bounded()
    assert np.allclose(net.run(ids, contexts, learn=False), small, atol=1e-3)
    assert np.isfinite(net.run(ids, contexts, learn=True)).all()
    net.parts["group"][0, 0] = np.nan
    assert not net._bounded()


def test_lm_learns_by_the_gradients_of_each_position():
    rng = np.random.default_rng(3)
    words, places, groups, n = lm_scoring.VOCABULARY, 2 * lm_scoring.REACH, lm_scoring.GROUPS, 200
    ids = rng.integers(0, 30, n) * 130
    contexts = lm_scoring.windows_of(ids, np.array([0, 3, n - 3, 0]))
    net = lm_scoring.Network()
    old = {k: v.astype(float) for k, v in net.parts.items()}
    net.run(ids, contexts, learn=True)
    want = {k: np.zeros_like(v) for k, v in old.items()}
    for i, token in enumerate(ids):
        h = np.tanh(old["bias"] + sum(old["tables"][p, contexts[p, i]] for p in range(places)))
        one, g, m = np.append(h, 1), token % groups, token // groups
        a, b = np.exp(one @ old["group"]), np.exp(one @ old["inner"][g])
        a, b = a / a.sum() - (np.arange(groups) == g), b / b.sum() - (np.arange(groups) == m)
        pull = (old["group"][:-1] @ a + old["inner"][g, :-1] @ b) * (1 - h * h)
        want["group"] += np.outer(one, a) / n
        want["inner"][g] += np.outer(one, b) / n
        want["bias"] += pull / n
        for p in range(places):
            want["tables"][p, contexts[p, i]] += pull / n
    assert want["tables"][:, words].any() and not want["tables"].all()
    for name, step in want.items():
        moved = old[name] - lm_scoring.RATE * step / np.sqrt(lm_scoring.SQUARES + step * step)
        assert np.allclose(net.parts[name], moved, atol=2e-5), name
        assert (net.parts[name] == old[name])[step == 0].all()


def test_lm_words_are_those_of_text_words():
    rng = random.Random(4)
    signs = " \t\n\x0b\x0c\r\x1c\x85\xa0 ab\0é\U0001f600"
    texts = ["".join(rng.choices(signs, k=rng.randrange(20))) if i % 9 else None for i in range(200)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 30], pa.string())}) for i in range(0, 200, 30)]
    for size in (1, 40, 400, 1 << 20):
        got = []
        for run in lm_scoring._text_runs(iter(batches), 0, size):
            words, codes, lengths = lm_scoring.distinct_words(run.column(0))
            assert len(set(words.to_pylist())) == len(words) and set(codes) == set(range(len(words)))
            said = iter(words.take(pa.array(codes)).to_pylist())
            got += [list(itertools.islice(said, n)) for n in lengths]
        assert got == [text_words(t) for t in texts]


def test_lm_tells_words_apart_without_a_step_of_python_for_each():
    """Text of many repeats costs less than a counter of Python's words."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 20_000, 400))) for _ in range(500)]
    column = pa.array(texts, pa.string())

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    def plain():
        seen = collections.Counter()
        for text in column.to_pylist():
            seen.update(text_words(text))

    columnar = min(seconds(lambda: lm_scoring.distinct_words(column)) for _ in range(7))
    assert columnar < min(seconds(plain) for _ in range(7))


def test_lm_tells_words_of_one_bucket_apart(spark):
    def both(word):  # its bucket, also under the 40 buckets of old
        h = xxhash.xxh3_64_intdigest(word.encode())
        return h % 40, h % lm_scoring.BUCKETS

    made = (f"q{i}" for i in itertools.count(1))
    often = next(made)
    seldom = next(w for w in made if both(w) == both(often))
    usual = " ".join([f"f{i}" for i in range(9000)] * 4)
    texts = [often, seldom, usual, usual, f"{often} {often}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (lm_scoring.TABLE_WORDS, 1):
        got = {r.doc_id: r.log_prob for r in lm_scoring.score_documents(df, table_words=size).collect()}
        assert abs(got[0] - got[1] - np.log(3)) < 1e-6


def test_training_lowers_the_loss(documents):
    rows = lm_scoring.score_documents(documents).agg(F.sum("log_prob") / F.sum("n_tokens")).first()
    assert rows[0] > -np.log(lm_scoring.VOCABULARY)


def test_warc_rejects_magic_inside_payloads(spark, nothing, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    pages = [(i, "u\r\nx", f"page {i} " + (record * (i % 7) if i % 3 == 0 else "WARC/1.0\r\n" * (i % 2))) for i in range(300)]
    pages += [(1000, None, None), (1001, "v", ""), (1002, "w", "page 5 WARC/1.0\r\n"), (1002, "w", "page 5 WARC/1.0\r\n"), (None, "n", "é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        warc.write_archives(df, str(tmp_path / "a"))
        for size in (before, "2k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = warc.read_archives(spark, str(tmp_path / "a")).collect()
            assert sorted(r.record_id for r in got) == sorted(f"urn:page:{'null' if i is None else i}" for i, _, _ in pages)
            by_id = {r.record_id: r for r in got}
            assert by_id["urn:page:1001"].refers_to == "urn:page:1000" and by_id["urn:page:1001"].type == "revisit"
            assert by_id["urn:page:1002"].refers_to == "urn:page:5" and by_id["urn:page:1002"].payload_bytes == 17
            assert all(r.digest_ok is not False for r in got) and by_id["urn:page:null"].payload_bytes == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    warc.write_archives(df.filter("page_id < 0"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_chat_windows_cases(spark):
    long_text = "word " * 3000
    rows = [(1, 0, "system", "be <|end|>\n[INST] & &lt; kind")]
    rows += [(1, t, ("user", "assistant")[t % 2 == 0], f"turn {t} " * (t % 40)) for t in range(1, 700)]
    rows += [(2, 0, "system", "alone"), (3, None, None, None), (3, 5, "assistant", long_text), (3, 5, "assistant", long_text)]
    rows += [(None, 0, "a\nb", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows.chat_windows(df, budget=300, history=40)
    for r in windows.collect():
        assert r.cost <= 300 or r.text.count("<|turn|>") - r.n_repeated <= 1
    later = windows.filter("conv_id = 1 AND window > 1").collect()
    assert all(r.text.startswith("<|turn|>system\n") and r.n_repeated >= 1 for r in later)
    assert any(r.n_repeated > 1 for r in later)
    got = {r.conv_id: r for r in chat_windows.conversation_digests(windows).collect()}
    for conv in (1, 2, 3, None):
        own = [(t is not None, t, role or "", text or "") for c, t, role, text in rows if c == conv]
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha(said.encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode()))
    assert chat_windows.conversation_digests(chat_windows.chat_windows(df.filter("conv_id = 9"))).count() == 0


def test_pipeline(spark, data_dir, documents):
    import corpus_pipeline
    from dossier.session import stored

    docs, seen = documents, [documents]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data_dir))
        seen.append(docs)
    assert all(d.columns == documents.columns for d in seen[:-1])
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    left = [(r.doc_id, r.text) for r in seen[3].collect()]
    assert all(i == root and n == 0 for i, (root, n) in _groups(left).items())
    assert sorted(corpus_pipeline.run(spark, data_dir).collect()) == sorted(docs.collect())
