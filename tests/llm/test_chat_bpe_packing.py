import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidebook.llm import bpe, chat_format, packing

from .data import awkward, documents, prose

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["", "a<|im_end|>b", "\\", "\\<|", "<\\|", "<|", "<<||", "x\\n\ny", "<\\\\|im"])
def test_escape_is_reversible(text):
    for line in (False, True):
        e = chat_format.escape(text, line)
        assert "<|" not in e and chat_format.unescape(e, line) == text
    rendered, a, b = chat_format.render(text, text)
    assert chat_format.parse(rendered) == [(text, text)] and chat_format.unescape(rendered[a:b]) == text


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_windows_cover_each_turn_once_within_budget():
    r = random.Random(3)
    for _ in range(60):
        turns = [("system", "be kind")] * r.randrange(2) + [(r.choice(["user", "assistant"]), "w " * r.randrange(60)) for _ in range(r.randrange(1, 40))]
        got = list(chat_format.windows(iter(turns), lambda s: len(s.split()), 120, 40))
        seen, said = [], ""
        for first, new, repeated, tokens, text, spans in got:
            blocks = chat_format.parse(text)
            assert first == len(seen) and len(blocks) == new + repeated and (tokens <= 120 or new == 1)
            if first and turns[0][0] == "system":
                assert blocks[0] == turns[0]
            seen += blocks[repeated:]
            said += "".join(chat_format.unescape(text[a:b]) for a, b in spans)
        assert seen == turns and said == "".join(t for role, t in turns if role == "assistant")


def test_leading_system_turns_are_retained_within_their_limit():
    words = lambda s: len(s.split())
    turns = [("system", f"rule {i} " + "w " * 20) for i in range(6)] + [("user", "q " * 30), ("assistant", "a " * 30)] * 8
    got = list(chat_format.windows(iter(turns), words, 120, 30, 60))
    seen = []
    for first, new, repeated, tokens, text, _ in got:
        blocks = chat_format.parse(text)
        assert first == len(seen) and len(blocks) == new + repeated and (tokens <= 120 or new == 1) and tokens == sum(words(chat_format.render(*b)[0]) for b in blocks)
        before = turns[:first]
        assert all(b in before for b in blocks[:repeated])
        assert len({b for b in blocks if b[0] == "system"}) == sum(b[0] == "system" for b in blocks)  # none twice
        assert not first or blocks[0] == turns[0]
        seen += blocks[repeated:]
    assert seen == turns and len(got) > 4
    many = [("system", "w " * 8)] * 3000 + [("user", "x")]  # output stays in proportion to the input
    assert sum(len(w[4]) for w in chat_format.windows(iter(many), words, 120, 30, 60)) < 4 * sum(len(chat_format.render(*t)[0]) for t in many)


def test_conversations_round_trip(spark):
    r = random.Random(5)
    rows = [(c if c else None, t if t % 9 else None, r.choice(["user", "assistant", "system", None, "to\nol"]), r.choice([None, "", "<|im_end|>", prose(t, 40), "é\U0001f600" * 9]), 1) for c in range(8) for t in range(r.randrange(1, 25))]
    rows += rows[:3] + [(77, 0, "user", prose(1, 9000), 1), (77, 1, "assistant", prose(2, 9000), 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")
    got = {x.conv_id: x for x in chat_format.read_back(chat_format.format_conversations(df, RANKS, P.PATTERN)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    texts = defaultdict(int)
    for x in chat_format.format_conversations(df, RANKS, P.PATTERN).collect():
        texts[x.conv_id] += len(x.text)
    assert {c: x.formatted_chars for c, x in got.items()} == texts
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0), RANKS, P.PATTERN)).count() == 0
    for c, v in by.items():
        v.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3], x[4].encode()))
        assert (got[c].n_turns, got[c].turns_sha256) == (len(v), sha("".join(f"{x[2]}\n{x[4]}\n" for x in v)))
        said = "".join(x[4] for x in v if x[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))


def test_bpe_is_the_library_on_whole_texts(spark):
    enc = bpe.encoding(RANKS, P.PATTERN)
    texts = [r[1] for r in awkward()] + ["a" * 5000, " \n \n  x", "日本語 テキスト" * 30, "don't  stop.\n\n end "]
    for t in texts:
        for size in (1, 5, 64):
            assert bpe.encode_text(t, RANKS, P.PATTERN, size) == enc.encode_ordinary(t or "")
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    for r in bpe.round_trip(documents(spark, rows), RANKS, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))
    back = bpe.decode(bpe.encode(documents(spark, rows), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.id: bytes(r.raw) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_word_tokens_are_the_library(spark):
    tok, whole = packing.WordTokens(WORDS), Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    for t in ["<|endoftext|> Hi", "É Ünïcode ſ ΑΣ'Σ.", "é ́x", "12³½ x²y don't I'LL 'sx", "日本語 한국어", "🙂a", "İx", "ª×÷¡", "\x00a\x7f\x85b\x1cc", *[r[1] or "" for r in awkward()]]:
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_take_whole_texts():
    path = P.path("byte_bpe_50k.json")
    tok, whole = packing.WordTokens(path), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    assert not tok.by_word and packing.WordTokens(WORDS).by_word
    for t in ["Two  words\n\nÉ <|endoftext|>", "", None]:
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_pack_places_each_token_once():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.choice([1, 2, r.randrange(1, 300), r.randrange(1, 9000), 2048]) for _ in range(r.randrange(0, 80))]
        seqs, left = packing.pack(lengths)
        assert left == []
        seen = defaultdict(list)
        for s in seqs:
            total = sum(p[2] for p in s)
            assert total == 2048 or total & (total - 1) == 0
            for d, a, n in s:
                seen[d].append((a, n))
        for d, n in enumerate(lengths):
            at = 0
            for a, k in sorted(seen[d]):
                assert a == at and k > 0
                at += k
            assert at == n
        groups = Counter(packing.step_groups([(sum(p[2] for p in s), len(s)) for s in seqs], 8192))
        assert not groups or max(groups.values()) - min(groups.values()) <= 1


def test_every_tier_is_packed_and_gaps_take_shorter_ones():
    r = random.Random(2)
    lengths = [r.choice([r.randrange(1, 300), r.randrange(1, 1500), r.randrange(1, 5000)]) for _ in range(2000)]
    seqs, _ = packing.pack(lengths)
    windows = Counter(sum(p[2] for p in s) for s in seqs)
    assert all(windows[t] > 50 for t in packing.TIERS) and sum(v for t, v in windows.items() if t not in packing.TIERS) <= 8
    routed = lambda n: next(t for t in packing.TIERS if t >= n)
    whole = {d: n for d, n in enumerate(lengths) if n <= 2048}
    filled = 0
    for s in seqs:
        size = sum(p[2] for p in s)
        if size in packing.TIERS:
            assert routed(s[0][2]) == size  # opened by a piece of its own tier
            filled += any(routed(p[2]) < size for p in s[1:])
    own = sum(routed(n) == sum(p[2] for p in s) for s in seqs for d, a, n in s if whole.get(d) == n and n > 256)
    assert filled > 200 and own > 0.5 * sum(n > 256 for n in whole.values())
    costs = [(sum(p[2] for p in s), sum(p[2] ** 2 for p in s)) for s in seqs]
    groups = packing.step_groups(costs, 32 * 2048)
    by = defaultdict(list)
    for g, c in zip(groups, costs):
        by[g].append(c)
    assert len(by) == -(-sum(lengths) // (32 * 2048))
    for t in packing.TIERS:
        n = [sum(c[0] == t for c in v) for v in by.values()]
        assert max(n) - min(n) <= 2 and max(n) > 0
    cost = [sum(c[1] for c in v) for v in by.values()]
    assert max(cost) < 1.1 * min(cost)


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER", 5000)
    rows = awkward()
    out = packing.pack_documents(documents(spark, rows).coalesce(2), WORDS, with_ids=True).collect()
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == s[0].sequence_tokens <= 2048
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(whole.encode(t or "", add_special_tokens=False).ids + [1])
    for i, texts in want.items():
        if len(texts) == 1:
            assert [x for r in sorted(docs[i], key=lambda r: r.start) for x in r.ids] == texts[0]
        assert sum(r.length for r in docs[i]) == sum(map(len, texts))
    assert packing.pack_documents(documents(spark, []), WORDS).count() == 0
