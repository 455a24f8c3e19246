import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from brainweave.llm import packing


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [packing.END_ID] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_hold_the_documents_ids_and_sequences_hold_the_pieces(spark):
    r = random.Random(3)
    texts = ["", None, "a", "two  blanks\n\nand lines", "<|endoftext|> é 日本 😀", "in a text<|endoftext|>there", "a\n \n b \u3000 ", " ", "x" * 9000, *[" ".join(r.choices(["The", "word", "naïve", "12", "it's", "\n"], k=r.randint(1, 900))) for _ in range(60)]]
    rows = list(enumerate(texts))
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=256).collect()
    ids = {d: np.array(i, "<u4") for (d, _), i in zip(rows, reference_ids([t or "" for t in texts]), strict=True)}
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]] and sum(p.length for p in ps) == len(ids[d])
        assert len(ps) == -(-len(ids[d]) // 256) and all(p.length == 256 for p in ps[1:])
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]] and sum(p.length for p in ps) <= 256


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing takes, one document at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def steps_of(counts, capacity, ranges=packing.RANGES):
    """What packing.plan gives, without Spark: (length, lo, hi, each, first, at)."""
    steps, state, fresh = [], [], 0
    for n in sorted(counts, reverse=True):
        if 2 * n > capacity:
            steps.append((n, 0, counts[n], 1, fresh, 0))
            state += [("gap", capacity - n, fresh, counts[n])] if n < capacity else []
            fresh += counts[n]
        else:
            state.append(("doc", n, 0, counts[n]))
    for k in ranges:
        dealt = {}
        for kind, *run in state:
            dealt.setdefault((run[0] - 1) * k // capacity, {"doc": [], "gap": []})[kind].append(tuple(run))
        done = [row for r in dealt.values() for row in packing.sweep(r["doc"], r["gap"], capacity, fresh if k == 1 else None)]
        steps += [(n, lo, lo + c, each, to, at) for kind, n, lo, c, each, to, at in done if kind == "step"]
        state = [r[:4] for r in done if r[0] != "step"]
    return steps


def check_steps(steps, lengths, capacity):
    used = {}
    for n, lo, hi, each, first, at in steps:
        for k in range(hi - lo):
            used.setdefault(first + k // each, []).append((at + k % each * n, n))
    assert sorted(n for v in used.values() for _, n in v) == sorted(lengths)
    for v in used.values():
        v.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(n for _, n in v) <= capacity
    assert len(used) <= best_fit(lengths, capacity)


def test_plan_takes_no_more_sequences_than_best_fit_one_at_a_time():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.choice((r.randint(1, 64), 5, 33)) for _ in range(r.randint(1, 300))]
        check_steps(steps_of({n: lengths.count(n) for n in set(lengths)}, 64), lengths, 64)


def test_rounds_on_spark_place_every_run_once(spark):
    r = random.Random(7)
    for most in (64, 20):
        lengths = [r.choice((r.randint(1, most), 5, 3)) for _ in range(r.randint(100, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        steps = packing.plan(spark.createDataFrame(list(counts.items()), "length long, count long"), 64).collect()
        check_steps([(s.value, s["first"], s["first"] + s.n, s["each"], s.to, s["at"]) for s in steps], lengths, 64)
        assert sorted(tuple(s)[1:] for s in steps) == sorted((n, lo, hi - lo, *rest) for n, lo, hi, *rest in steps_of(counts, 64))


def test_ties_repeated_rows_null_ids_empty_table_and_extra_columns(spark):
    rows = [(1, "same text", 5), (1, "same text", 5), (None, "same text", 5), (None, None, 5)] * 3
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length long"), capacity=16).collect()
    assert len(got) == 12 and len({(p.sequence_id, p.offset) for p in got}) == 12
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_are_met_again_are_encoded_once(monkeypatch):
    """220,000 words in portions, twice: some as many as a task of 16 MB has would be encoded again if fewer were kept."""
    own, size, special = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.append(sum(map(len, texts)))
            return own.encode_batch_fast(texts, **options)

    monkeypatch.setattr(packing, "tokenizer", lambda path: (Counting(), size, special))
    encode = packing.encoder("")
    portions = [[" ".join(["", *(f"w{i}" for i in range(k, k + 20_000))])] for k in range(0, 220_000, 20_000)]
    first = [encode(p) for p in portions]
    once = sum(seen)
    assert [encode(p) for p in portions] == first and sum(seen) == once


def test_ids_are_the_tokenizers_wherever_pieces_are_cut():
    r = random.Random(11)
    odd = [*" \n\t'.,!a1B_é\u00df\u00b2\u2167\u0301\u65e5\u00a0\u3000\x1c\x85\x0b\x00\x01\ufb01\u00aa\u02bc\u01c5\u0660\u00b7\u00d7\u200d", "<|endoftext|>"]
    texts = ["", "\x00", "\n", "it's 'tis ' s don't--'s x'", "a.\nB", "a.\n\nB", "x" * 300 + ", " + "y" * 300]
    texts += ["".join(r.choices(odd, [6, 4] + [1] * (len(odd) - 2), k=r.randint(1, 25))) for _ in range(4000)]
    texts += ["".join(r.choices(" \n'.,!a1é", k=r.randint(1, 30))) for _ in range(4000)]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = [ids for k in range(0, len(texts), 500) for ids in encode(texts[k : k + 500])]
    assert got == [np.array(ids[:-1], "<u4").tobytes() for ids in reference_ids(texts)]


def test_a_word_is_encoded_once_whatever_punctuation_follows(monkeypatch):
    own, size, special = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.append(sum(map(len, texts)))
            return own.encode_batch_fast(texts, **options)

    monkeypatch.setattr(packing, "tokenizer", lambda path: (Counting(), size, special))
    words = [f"word{i}" for i in range(1000)]
    texts = [after.join(words) for after in (" ", ", ", ". ", "! ", "; ", ".\n", ",\n", "\n")]
    packing.encoder("")(texts)
    assert sum(seen) < 3 * len(texts[0])  # each word after a blank and after a line's end, with what stands between
