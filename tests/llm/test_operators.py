"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from grainwise.llm import bagminhash, chat_format, decontamination, language_id, packing, sharding, spotsigs, substring_dedup, suffix_tree, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["the", "of"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = say(40), say(120).split(" ")
    rows = [(i, say(rng.randint(0, 90))) for i in range(40)]
    rows += [(40 + i, say(20) + "\n" + shared + "\t" + say(10)) for i in range(6)]
    for i in range(8):
        near = list(base)
        for _ in range(i):
            near[rng.randrange(120)] = "zz%d" % rng.randrange(99)
        rows.append((50 + i, " ".join(near)))
    return [*rows, (60, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (64, " \n"), (65, "one"), (66, say(30_000)), (67, "x " * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "extra") for i, t in corpus()], "doc_id long, text string, lang string, source string, n_chars long, label string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_substring_dedup(docs, empty):
    words = {i: WORD.findall(t or "") for i, t in corpus()}
    first: dict = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][s : s + 13]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(docs).collect()} == want
    assert substring_dedup.remove_repeats(empty).count() == 0
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 61").count() == (len(words[3]) < 13)


def test_near_duplicates(docs, empty):
    def bag(t):
        w = WORD.findall(t or "")
        return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    rows = corpus()
    bags, label = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}
    texts = dict(rows)
    for _ in range(4):
        for i in bags:
            for j in bags:
                both = sum((bags[i] & bags[j]).values()) if i < j and bags[i] and bags[j] else 0
                if i < j and ((texts[i] or "") == (texts[j] or "") or both and both >= 0.8 * (bags[i].total() + bags[j].total() - both)):
                    label[i] = label[j] = min(label[i], label[j])
    got = bagminhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == label
    assert {r.doc_id for r in got if r.is_kept} == set(label.values())
    assert bagminhash.near_duplicates(empty).count() == 0


def test_suffix_tree(docs, empty):
    held = suffix_tree.crc_remainder("doc_id", 10) == 0
    got = {r.doc_id: r for r in suffix_tree.train_and_score(docs, held).collect()}
    tokens = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None] for i, t in corpus()}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = train.total(), len(train)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert suffix_tree.train_and_score(empty, held).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers
    import numpy as np

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    for i, t in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert pieces == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    fill: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) // 4096 + 2
    assert packing.pack(empty).count() == 0


def test_tokenizer_twin_on_odd_texts():
    from tokenizers import Tokenizer
    import public_tokenizers
    import numpy as np

    odd = ["", "<|endoftext|> a", "İstanbul ǅ ﬀ é é", "don't I'LL ''s 12 ½ ٣", "\x1c a\x1fb\x00\x01", "ΑΣ Σ.\xa0\x85　x​", "́a %%%***", "日本語 🎉🎉"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.Ids("word_bpe_49k.json", 10)(odd) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == len(corpus())
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(16))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    texts = dict(corpus())
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert sharding.shard(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rows = corpus()
    items = [(1, rows[41][1]), (2, "ONE"), (3, ""), (4, None), (None, rows[5][1]), (5, "nothing here is in any text at all of them")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for item, t in items:
        w = find(t)
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + min(10, len(w))]), set()).add(item)
    for p in (decontamination.Decontamination(), decontamination.Decontamination(broadcast_bytes=4000)):
        got = {r.doc_id: r for r in decontamination.decontaminate(docs, benchmark, p).collect()}
        for i, t in rows:
            w, hit, named = find(t), set(), set()
            for k in {len(x) for x in windows}:
                for s in range(len(w) - k + 1):
                    if tuple(w[s : s + k]) in windows:
                        hit |= set(range(s, s + k))
                        named |= windows[tuple(w[s : s + k])]
            names = sorted(str(x) for x in named if x is not None)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(rows)
    cut = decontamination.clean(docs, benchmark, remove="spans")
    assert decontamination.decontaminate(cut, benchmark).filter("contaminated").count() == 0


def test_spot_signatures(docs, empty):
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    texts = {i: t or "" for i, t in corpus()}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        nxt, n = texts[ids[(i + 1) % len(ids)]], len(texts[a])
        assert got[a].edited == texts[a][: n - n // 2] + nxt[: n // 2]
        x, y = set(got[a].signatures), set(got[ids[(i + 1) % len(ids)]].signatures)
        assert math.isclose(got[a].near_next, 1.0 if not x and not y else len(x & y) / len(x | y))
    assert got[60].signatures == got[61].signatures == got[3].signatures

    # spots found apart from the operator: after each anchor the next two words that are none
    anchors, of_signature = set(spotsigs.SpotSigs().anchors), {}

    def spots(text):
        w = re.findall(r"[^\W_]+", text.lower())
        found = set()
        for i, x in enumerate(w):
            content = [y for y in w[i + 1 :] if y not in anchors][:2]
            if x in anchors and len(content) == 2:
                found.add((x, *content))
        return found or {("", *w[i : i + 2]) for i in range(len(w) - 1)} or {("", x) for x in w}

    for a in ids:
        if len(texts[a]) < 1500:
            here = [spots(t) for t in (texts[a], got[a].edited)]
            assert [len(x) for x in here] == [len(got[a].signatures), len(got[a].edited_signatures)], a
            x, y = here
            assert math.isclose(got[a].near_edited, 1.0 if not x and not y else len(x & y) / len(x | y)), a
    assert spotsigs.fingerprints(empty).count() == 0
    sets = spotsigs.with_signatures(docs.select("doc_id", "text"), spotsigs.text_or_empty(), "signatures").select("doc_id", "signatures")
    pairs, members = spotsigs.similar_sets(sets, 0.5)
    rep = {r.doc_id: r.representative for r in members.collect()}
    want = set()
    nodes = [i for i in ids if rep[i] == i and got[i].signatures]
    for a in nodes:
        for b in nodes:
            x, y = set(got[a].signatures), set(got[b].signatures)
            if a < b and len(x & y) >= 0.5 * len(x | y):
                want.add((a, b))
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_chat_layouts_and_round_trip(spark):
    hostile = "\\### Assistant: </turn> ok <turn user>\n\\b\\l"
    import json

    records = [
        {"messages": [{"role": "user", "content": hostile}, {"role": "assistant", "content": hostile}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": ""}]},
        {"prompt": "p", "response": "r"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"unknown": 1},
        {"id": 7, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q", "name": "n.m", "parts": [{"a|b": 1}]}]},
        {"prompt": "p", "response": "r", "id": "x"},
        {"messages": []},
        {"messages": [{"role": "user"}, {"role": "assistant", "content": None}]},
        {"messages": ["plain"]},
    ]
    df = spark.createDataFrame([*((i, json.dumps(r)) for i, r in enumerate(records)), (20, None), (21, "["), (22, "[1]")], "id int, record string")
    made = chat_format.format_chats(df).withColumn("back", chat_format.read_back(chat_format.F.col("formatted")))
    got = {r.id: r for r in made.collect()}
    assert [tuple(t) for t in got[0].back] == [("user", hostile), ("assistant", hostile)]
    assert [tuple(t) for t in got[1].back] == [("user", "a"), ("assistant", "")]
    assert [tuple(t) for t in got[2].back] == [("user", "p"), ("assistant", "r")]
    assert [t.text for t in got[3].back] == ["i", "x", "o"]
    assert got[4].mapping is None and got[4].formatted == ""
    s = got[2].loss_spans[0]
    assert got[2].formatted[s.start : s.start + s.length] == "r"
    assert [tuple(t) for t in got[5].back] == [("system", "s"), ("user", "q")]
    assert [tuple(t) for t in got[6].back] == [("user", "p"), ("assistant", "r")]
    assert (got[7].mapping, got[7].formatted, got[7].status) == ("messages", "", "mapped")
    assert [tuple(t) for t in got[8].back] == [("user", ""), ("assistant", "")]
    assert [got[i].status for i in (4, 9, 20, 21, 22)] == ["unknown schema", "unknown schema", "null record", "no JSON object", "no JSON object"]
    paths = df.filter("id = 5").select(chat_format.schema_paths(chat_format.F.col("record")).alias("p")).first().p.split("|")
    assert paths == sorted(["id", "messages", "messages[].content", "messages[].name", "messages[].parts", "messages[].parts[].a~3b", "messages[].role"])


def test_chat_query_goes_through_the_layouts(spark):
    rows = [(c, t, r, f"{r} says {c}/{t} <x>") for c in range(60) for t, r in enumerate(["user", "assistant"] * (1 + c % 2))]
    rows += [(100, 1, "user", "a"), (100, 1, "user", "a"), (100, 1, "assistant", None), (100, None, None, "first"), (None, 0, "assistant", ""), (101, 0, "human", "kept")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(chat_format.records_of(df)).withColumn("back", chat_format.read_back(chat_format.F.col("formatted")))
    got = {r.conv_id: r for r in made.collect()}
    assert {r.mapping for r in got.values()} == {"messages", "conversations", "turns", "prompt_response"}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [tuple(t) for t in got[c].back] == [(r, t) for _, r, t in turns]
        spoken = [chat_text(got[c].formatted[s.start : s.start + s.length]) for s in got[c].loss_spans]
        assert spoken == [t for _, r, t in turns if r == "assistant"]
    assert chat_format.format_chats(chat_format.records_of(df.limit(0))).count() == 0


def chat_text(s):
    return s.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")


def test_toxicity(spark):
    rng = random.Random(3)
    plain = ["garden", "river", "letter", "window", "paper", "stone", "market", "winter"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(12)]
        bad = i % 4 == 0
        if bad:
            words[3] = "wretch"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    more = [(1000, "a river wr3tch market"), (1001, "the w r e t c h stone"), (1002, "wreeetch"), (1003, "paper stone"), (1004, None), (1005, "")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, suffix_tree.crc_remainder("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(b) for i, b in labels)
    assert min(got[1000], got[1001], got[1002]) >= 0.7 > max(got[1003], got[1004], got[1005])
    assert set(toxicity.score(docs, toxicity.fit(docs, marks.limit(0), suffix_tree.crc_remainder("doc_id", 3) != 1)).select("score").distinct().toPandas()["score"]) == {0.0}


def test_language(spark):
    docs = spark.createDataFrame([(i, ["the river and the house of the king", "der Fluss und das Haus des Königs"][i % 2] * 3, ["en", "de"][i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    pages = [(i, f"http://a.example.de/{i}", f'<html lang="de"><body>das Haus und der Fluss {i}</body></html>') for i in range(5)]
    pages += [(10, "http://a.example.de/x", "<html><body>12</body></html>"), (11, None, None), (12, "http://b.example.com", '<html lang="en"><p>the house of the river</p></html>')]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(pages) and all(got[i].language == "de" for i in range(5))
    assert got[10].language == "de" and got[12].language == "en"
    assert language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0)).filter("language is null").count() == len(pages)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus()[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(out.doc_id)
    assert 61 not in kept and 7 not in kept and 3 in kept


def test_suffix_tree_against_brute_force(spark):
    """Evidence floors do not rise with the corpus, and contexts are as long as the test keeps them."""
    rng = random.Random(5)
    sentences = ["red fox ran over hill", "blue fox ran under hill", "old red fox ran into town", "a a a a a b", "a a a a a b"]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(12)) + " w%d" % (i % 7)) for i in range(200)] + [(200, "never seen fox ran"), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for frequent in (1_000_000, 0, 20):
        q = suffix_tree.SuffixTree(least=3, entry=2, share=1.0, entry_share=1.0, frequent=frequent)
        got = {r.doc_id: r for r in suffix_tree.train_and_score(docs, suffix_tree.F.col("doc_id") >= 150, q).collect()}
        seqs = {i: ["$", *(t or "").split(), "$"] for i, t in rows}
        train = [s for i, s in seqs.items() if i < 150]
        uni = Counter(w for s in train for w in s[1:])
        total = uni.total() + 0.1 * (len(uni) + 1)
        states: dict = {}

        def prob(ctx, w):
            while ctx and ctx not in states:
                ctx = ctx[1:]
            if not ctx:
                return (uni[w] + 0.1) / total
            entries, left = states[ctx]
            return entries[w] if w in entries else left * prob(ctx[1:], w)

        d = 1
        while True:
            after: dict = {}
            for s in train:
                for i in range(d, len(s)):
                    after.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
            new = {}
            for ctx, c in after.items():
                kept, size = {w: n for w, n in c.items() if n >= 2}, c.total()
                if size < 3 or not kept or d > 1 and ctx[1:] not in states:
                    continue
                below = {w: prob(ctx[1:], w) for w in kept}
                rest, parent = size - sum(kept.values()), min(sum(below.values()), 1 - 1e-9)
                gain = sum(n * math.log(n / size / below[w]) for w, n in kept.items()) + (rest * math.log(rest / size / (1 - parent)) if rest else 0)
                if gain > 0.5 * len(kept) * math.log(size + 1):
                    e = {w: (n + len(kept) * below[w]) / (size + len(kept)) for w, n in kept.items()}
                    new[ctx] = (e, max(1 - sum(e.values()), 1e-12) / (1 - parent))
            if not new:
                break
            states.update(new)
            d += 1
        assert d > 4  # how many "a" came before tells whether "b" follows
        for i, s in seqs.items():
            assert math.isclose(got[i].score, sum(math.log10(prob(tuple(s[:j]), s[j])) for j in range(1, len(s))), rel_tol=1e-6), i


def test_suffix_tree_floors_are_numbers_of_sightings():
    p = suffix_tree.SuffixTree()
    assert p.floors(5 * 10**9) == p.floors(5 * 10**11) == (p.least, p.entry)
    assert p.floors(10**5) == (1, 1)


def test_suffix_tree_needs_the_same_sightings_at_every_size(spark):
    """A run of 31 sightings is no context in a small corpus either, one of 32 is."""
    for n in (31, 32):
        rows = [(i, "left right") for i in range(n)] + [(-1, "left right")]
        got = suffix_tree.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), suffix_tree.F.col("doc_id") < 0)
        r = got.filter("doc_id = -1").first()
        assert r.train_tokens == 3 * n and (r.score > r.base_score + 1e-9) == (n == 32)


def test_suffix_tree_counts_leave_a_task_packed(monkeypatch):
    """Counts of runs pass on as a few rows, however many runs there are, and add up to those of all tasks."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(300))) for _ in range(60)] + [None, "", "x " * 2000]
    every = SimpleNamespace(value=(np.full(1 << (suffix_tree._BITS - 6), 2**64 - 1, np.uint64),) * 2)
    monkeypatch.setattr(suffix_tree, "_HELD", 500)
    for d in (1, 3):
        packed = [b for half in (texts[:30], texts[30:]) for b in suffix_tree._grams(every, d, 5)(iter([pa.RecordBatch.from_pydict({"text": pa.array(half, pa.string())})]))]
        parts = pa.Table.from_batches(packed)
        assert parts.num_rows <= 10 * len(packed)
        got = Counter()
        for part in range(5):
            own = parts.filter(pa.compute.equal(parts["part"], part)).combine_chunks().to_batches()
            for b in suffix_tree._added_up(2)(iter(own)):
                for ctx, suf, kind, n, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    assert (ctx, suf, kind) not in got
                    got[ctx, suf, kind] = n
        want: Counter = Counter()
        for t in texts:
            w = ["$", *(t or "").split(), "$"]
            for i in range(len(w) - d):
                want[tuple(w[i : i + d + 1]), False] += 1
                if d > 2:
                    want[tuple(w[i : i + d]), True] += 1
        assert sorted((k[2], n) for k, n in got.items()) == sorted((k[1], n) for k, n in want.items() if n > 1), d


def test_suffix_tree_frequent_words_go_as_numbers(monkeypatch):
    """Runs of frequent words take less room than their hashes; all counts are the same, whichever words have numbers."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(f"w{min(rng.randrange(1, 300), rng.randrange(1, 300))}" for _ in range(rng.randrange(400))) for _ in range(60)] + [None, "", "x " * 2000]
    batch = suffix_tree._batch(pa.RecordBatch.from_pydict({"text": pa.array([" ".join(f"w{i}" for i in range(1, 300)) + " x"])}))
    words = np.append(batch.word_hash, np.uint64(suffix_tree.END))
    bits = np.full(1 << (suffix_tree._BITS - 6), 2**64 - 1, np.uint64)
    some = np.random.default_rng(3).integers(0, 2**63, len(bits)).astype(np.uint64) * np.uint64(2)  # half of the suffixes get no entry
    monkeypatch.setattr(suffix_tree, "_HELD", 2000)
    for d in (1, 2, 3):
        made, room = [], []
        for known in ([], [words], [words[::3]]):
            shared = SimpleNamespace(value=(bits, some, *known))
            packed = [b for half in (texts[:30], texts[30:]) for b in suffix_tree._grams(shared, d, 5)(iter([pa.RecordBatch.from_pydict({"text": pa.array(half, pa.string())})]))]
            parts = pa.Table.from_batches(packed)
            room.append(sum(len(x.as_py()) for x in parts["counts"]))
            rows = [r for part in range(5) for b in suffix_tree._added_up(2, shared)(iter(parts.filter(pa.compute.equal(parts["part"], part)).to_batches())) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert len({r[:3] for r in rows}) == len(rows)
            made.append(sorted(rows))
        assert made[0] and made[0] == made[1] == made[2], d
        assert any(r[2] for r in made[0]) == (d == 3) and room[1] < 0.7 * room[0]


def test_suffix_tree_scores_ask_once_for_a_run(monkeypatch):
    """Scoring makes a few rows for each chunk of documents, however many rare words and runs they have, and adds up all of their values."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randrange(1, 900)}" for _ in range(rng.randrange(300))) for _ in range(200)] + [None, "", "x y " * 500]
    vocabulary = [*(f"w{i}" for i in range(1, 900)), "x", "y"]
    hash_of = dict(zip(vocabulary, suffix_tree._batch(pa.RecordBatch.from_pydict({"text": pa.array([" ".join(vocabulary)])})).word_hash.tolist(), strict=True))
    one = lambda h: np.array([h], np.uint64)
    run_hash = lambda a, b: int(suffix_tree.joined_hash(one(hash_of[a]), one(hash_of[b]))[0])
    count = {w: i % 50 + 1 for i, w in enumerate(vocabulary) if i % 4}
    value = {w: i / 7 for i, w in enumerate(vocabulary) if i % 5 == 1 and w in count}
    runs = {(a, b): rng.random() for t in texts for a, b in zip((t or "").split(), (t or "").split()[1:], strict=False) if rng.random() < 0.5}
    rows = [(hash_of[w], c, value.get(w, 0.0)) for w, c in count.items()] + [(run_hash(*r), 0, v) for r, v in runs.items()]
    h, c, v = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, float), strict=True))
    hot = np.flatnonzero(c > 40)
    hot = hot[np.argsort(h[hot])]
    shared = SimpleNamespace(value=(h[hot], c[hot].astype(float), v[hot], np.full(1 << (suffix_tree._BITS - 6), 2**64 - 1, np.uint64), 2, 0.1, 1e6))
    monkeypatch.setattr(suffix_tree, "_HELD", 5000)
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, len(texts))], pa.int64()), "held_out": pa.array([None, *[True] * (len(texts) - 1)], pa.bool_()), "text": pa.array(texts, pa.string()), "row": pa.array(range(len(texts)), pa.int64())})
    asked = [b for half in (docs.slice(0, 90), docs.slice(90)) for b in suffix_tree._score_docs(shared, 7)(iter(half.slice(i, 10) for i in range(0, len(half), 10)))]
    assert len(asked) > 3 and sum(b.num_rows for b in asked) <= 8 * len(asked)
    known = list(suffix_tree._pack_features(7)(iter([pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(v)], names=["h", "c", "value"])])))
    every = pa.Table.from_batches([*asked, *known])
    answers = pa.Table.from_batches([b for part in range(7) for b in suffix_tree._answered(iter(every.filter(pa.compute.equal(every["part"], part)).to_batches()))])
    got = pa.Table.from_batches(list(suffix_tree._scored(0.1, 1e6)(iter(answers.to_batches())))).to_pylist()
    got = {r["doc_id"] or 0: r for r in got}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = (t or "").split()
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["held_out"]) == (len(ws) + 1, sum(w in count for w in ws), True if i else None)
        assert math.isclose(got[i]["base"], sum(math.log10((count.get(w, 0) + 0.1) / 1e6) for w in ws), rel_tol=1e-9)
        assert math.isclose(got[i]["gain"], sum(value.get(w, 0) for w in ws) + sum(runs.get(r, 0) for r in zip(ws, ws[1:], strict=False)), rel_tol=1e-9, abs_tol=1e-12)


def test_chat_keeps_a_very_long_text(spark):
    long = chat_format.F.expr("repeat('x', 21000000)")
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string")
    rows = rows.withColumn("text", chat_format.F.when(chat_format.F.col("turn") == 0, long).otherwise("short"))
    made = chat_format.format_chats(chat_format.records_of(rows)).selectExpr("mapping", "length(formatted) n", "loss_spans").first()
    assert made.mapping is not None and made.n == 21_000_000 + 5 + 2 * 16 + 4 + 9 and len(made.loss_spans) == 1


def test_language_of_few_documents_is_known(spark):
    few = [(-1, "joki ja talo ja kuninkaan yö ja päivä", "fi"), (-2, "x", ""), (-3, "y", "?")]
    docs = spark.range(30_000).selectExpr("id", "'the river and the house of the king' text", "'en' lang").union(spark.createDataFrame(few, "id long, text string, lang string"))
    pages = [(1, None, "<p>kuninkaan talo ja joki ja kuninkaan päivä</p>" * 3), (2, None, "<p>the king of the river</p>")]
    got = {r.page_id: r.language for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got == {1: "fi", 2: "en"}


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(4)
    plain = ["garden", "river", "letter", "window", "paper", "stone", "market", "winter", "you", "are"]
    rows = [(i, " ".join(["wretch" if i % 4 == 0 and k == 3 else rng.choice(plain) for k in range(12)]), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), suffix_tree.F.lit(True))


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in sorted(toxicity.score(df, model).collect())]


def test_toxicity_of_long_stretches(spark, toxic_model):
    texts = ["wr" + "e" * 70 + "tch", "wretch" + "h" * 100_000, "wr3" + "t" * 80 + "ch"]
    assert min(scores(spark, toxic_model, texts)) >= 0.7
    restored = toxicity.Restorer(toxic_model.letters, toxicity.Toxicity()).decode(" ".join("wretch" * 40))
    assert restored == "wretch" * 40


def test_toxicity_of_single_marks_and_spaced_words(spark, toxic_model):
    texts = ["a wr.etch", "wr..e..t..c..h", "wr-etch", "wwrreettcchh", "wwretch", "you are a w r e t c h", "y o u a r e w r e t c h", " ".join("youarewretch" * 12)]
    assert min(scores(spark, toxic_model, texts)) >= 0.7
    assert max(scores(spark, toxic_model, ["a letter, paper!", "1,000 2,000", "stone-market"])) < 0.7
    found = toxicity.stretches(toxicity.Batch(*toxicity.text_bytes(toxicity.pa.array(["a$$ @$$ i..d 12,5 plain 2024-01-01 hello"]))))
    assert [(a, b) for _, a, b in found] == [(0, 3), (4, 7), (8, 12), (35, 40)]


def test_language_by_fusion(spark):
    """Where text alone fails, markup and host decide; where markup is wrong, text and host do."""
    rng = random.Random(11)
    words = {"en": "the river and house of king where every garden window holds bright morning light".split(), "de": "der Fluss und das Haus des Königs wo jeder Garten ein helles Fenster zum Morgen hat".split()}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 40), x) for i, x in enumerate(["en", "de"] * 60)], "doc_id long, text string, lang string")
    pages, truth, kind = [], {}, {}
    for i in range(600):
        x = rng.choice(["en", "de"])
        host = f"h{rng.randrange(6)}.{'anna' if x == 'de' else 'bob'}.org"
        what = ["text", "hidden", "wrong markup", "short"][i % 4]
        body = {"hidden": "4711 0815", "short": "ok"}.get(what) or say(x, 12)
        said = {"en": "de", "de": "en"}[x] if what == "wrong markup" else x if what != "hidden" else ""
        pages.append((i, f"https://{host}/{i}", f"<html{f' lang={said}' if said else ''}><p>{body}</p></html>"))
        truth[i], kind[i] = x, what
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), docs).collect()}
    right = lambda column, what: sum(got[i][column] == truth[i] for i in truth if kind[i] == what) / 150
    assert right("text_language", "hidden") < 0.7 and right("language", "hidden") > 0.95
    assert right("language", "short") > 0.95
    assert right("language", "wrong markup") > 0.95
    assert right("language", "text") > 0.95
    some = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "")], "page_id long, url string, html string")
    assert len(language_id.identify(some, docs).collect()) == 3
    assert language_id.identify(some.limit(0), docs).count() == 0


def test_restoring_is_the_best_reading(spark, toxic_model):
    """The Viterbi search against every reading of short strings."""
    from itertools import product

    p, model = toxicity.Toxicity(), toxic_model.letters
    restorer = toxicity.Restorer(model, p)

    def best(s):
        options = []
        for i, c in enumerate(s):
            some = [(c, 0.0)] if c.isalpha() else [(x, p.swap) for x in toxicity.LOOKALIKES.get(c, "")]
            nothing = p.skip if c in toxicity.SEPARATORS else p.repeat if i and c == s[i - 1] else None
            if not some and nothing is None or c in toxicity.PUNCTUATION:
                nothing = p.skip
            options.append(some + ([("", nothing)] if nothing is not None else []))
        found = {}
        for reading in product(*options):
            a = b = 0
            score = 0.0
            for x, cost in reading:
                score += cost
                if x:
                    k = ord(x) - 96
                    score, a, b = score + model[a][b][k], b, k
            text = "".join(x for x, _ in reading)
            found[text] = max(found.get(text, -1e9), score + model[a][b][0])
        return found

    for s in ["wr3tch", "w.r.e.t", "wwr33t", "1e7ter", "p@p3r", "st0ne!", "g4rd3n", "l3tt3rr", "9", "a-b", "||", "m4rk3t"]:
        found, got = best(s), restorer.decode(s)
        assert math.isclose(found[got], max(found.values()), rel_tol=1e-9), s


def structured(n):
    """Texts on which hashes that are linear in the letters meet: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_texts_stay_apart(spark, n):
    a, b = structured(n)
    words = [" ".join(x) for x in structured(n)]
    rows = [(i, t) for i, t in enumerate([a, b, *words, (a + " ") * 13, (b + " ") * 13])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in bagminhash.near_duplicates(df).collect() if r.copy_of != r.doc_id} == set()
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        gone = set()
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) < i:
                gone |= set(range(s, s + 13))
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == want
    got = {r.doc_id: r for r in suffix_tree.train_and_score(df, suffix_tree.F.col("doc_id").isin(1, 5)).collect()}
    assert got[1].n_known == 1 and got[5].n_known == 1 and got[0].n_known == 2


def test_maximal_repeats(spark):
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = say(40), say(13)
    rows = [(1, say(5) + passage + say(3)), (2, say(9) + passage[:30] + say(4) + other), (3, other + say(2) + passage[5:]), (4, say(20)), (5, None)]
    rows.append((6, rows[3][1]))
    df = spark.createDataFrame([(i, w and "  ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.repeats(df).collect())
    assert got == [(2, 9, 30, 1, 5), (3, 0, 13, 2, 43), (3, 15, 35, 1, 10), (6, 0, 20, 4, 0)]
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    assert kept[2] == "  ".join(rows[1][1][:9]) + "  " + "  ".join(rows[1][1][39:]) and 6 not in kept and kept[5] is None and kept[3] == "  ".join(rows[2][1][13:15]) + "  "


CLASHES = ["_id", "row", "key", "_key", "starts", "matches", "n_words", "n_removed", "text_key", "score", "kept", "label", "node", "anchor", "hit_spans", "_k0", "id", "w", "doc", "family"]


def test_further_columns_and_nulls_pass_every_stage(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, "one two three four five six seven"), (None, "one two three four five six seven"), (3, None), (3, None), (4, ""), (5, "the cat sat on the mat " * 30), (6, "the cat sat on the mat " * 30), (7, "x" * 300_000), (8, "a b c d e f g h i j k l m n o p q r s t u v w")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHES) for i, t in rows], schema)
    spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[8][1]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (df, df.limit(0)):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == df.columns
                got = now.collect()
                assert all(r[c] == c for r in got for c in CLASHES)
                now = spark.createDataFrame(got, df.schema)
                if docs is df:
                    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
                    assert len(ids) == {"toxicity": 9, "near_dedup": 5, "substring_dedup": 5, "decontamination": 4}[name], name
        assert (now.count() > 0) == (docs is df)


def test_every_operator_on_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "c " * 60)], "doc_id long, text string")
    held = suffix_tree.crc_remainder("doc_id", 10) == 0
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    runs = [
        lambda d: spotsigs.fingerprints(d), lambda d: substring_dedup.remove_repeats(d), lambda d: suffix_tree.train_and_score(d, held), lambda d: sharding.shard(d),
        lambda d: decontamination.decontaminate(d, benchmark), lambda d: bagminhash.near_duplicates(d), lambda d: packing.pack(d),
    ]
    for run in runs:
        assert run(df).count() == 5
        assert run(df.limit(0)).count() == 0
    assert decontamination.decontaminate(df, benchmark).filter("contaminated").count() == 3
    assert decontamination.decontaminate(df, benchmark.limit(0)).filter("contaminated").count() == 0


def test_shards_are_balanced(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 5, 40, 300])) for i in range(6000)] + [(10_000 + i, "hot " * 20) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("shard").agg({"size": "sum", "shard": "count"}).collect()
    assert len(got) == 16
    for k in (1, 2):
        assert max(r[k] for r in got) <= 1.1 * sum(r[k] for r in got) / 16
