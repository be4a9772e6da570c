"""The parts of the operators that need no Spark, against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from metasieve.llm import jpeg, media
from metasieve.llm.language import Labeller, fit_language_model, grams, letters_of, script_of
from metasieve.llm.line_dedup import remove_covered
from metasieve.llm.ngram_join import Shingler, linked, pair_overlap, prefix_length, suffix_bound
from metasieve.llm.packing import Packer
from metasieve.llm.quality import Vectors, fit_quality_model, score_texts, shape
from metasieve.llm.queries import vocabulary
from metasieve.llm.text_codec import ChunkCoder, _cut_of


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_coder_equals_library(name):
    from tokenizers import Tokenizer

    rng = random.Random(0)
    letters = " \n\t\r'sltreabAÉß1²½ª,.$!-|<>\x00İ日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " a", "a ", "a  b", "a \n b\n\nc", "x<|endoftext|>y <|EndOfText|>", "it's 'S we'LL ''s don't", "日本 text", "the the, The. the"]
    library = Tokenizer.from_file(vocabulary(name))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = ChunkCoder(vocabulary(name), True, most_kept=200), ChunkCoder(vocabulary(name), False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == want
    assert list(counts.encode(texts)) == [len(w) for w in want]


def test_words_used_again_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    path, rng, calls = vocabulary("word_bpe_49k.json"), random.Random(3), []
    words = list(dict.fromkeys("".join(rng.choice("abcdeéßſ") for _ in range(9)) for _ in range(4100)))[:4030]
    often, once = words[:30], words[30:]
    texts = [" ".join([*often, *(w + "., "[i % 3] for i, w in enumerate(once[at : at + 100])), *often]) + "'s 日"[: at // 100 % 5] for at in range(0, 4000, 100)]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    coder = ChunkCoder(path, True, most_kept=300)
    encode = coder.known.piece
    monkeypatch.setattr(coder.known, "piece", lambda k: calls.append(k) or encode(k))
    for at in range(0, len(texts), 4):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts[at : at + 4])] == want[at : at + 4]
    calls = [k for k in calls if len(k) >= 9]
    assert len(calls) == len(set(calls)) > 3000
    assert len(coder.known) <= 300 + 4 * 150


@pytest.mark.parametrize("most", [1, 60, 1 << 20])
def test_coder_in_groups_equals_library(monkeypatch, most):
    from tokenizers import Tokenizer

    monkeypatch.setattr("metasieve.llm.text_codec._GROUP_CHARS", most)
    rng = random.Random(4)
    inside = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180))]
    texts = ["".join(rng.choice(inside) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "\n\n", "日", "", "a" * 100 + " " + "." * 100, "it''s 'll'd can't''re 12a3 ²x½", " 'S\t<|endoftext|>", ""]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    coder = ChunkCoder(vocabulary("word_bpe_49k.json"), True, most_kept=20)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(coder.encode([])) == []


def test_only_known_patterns_are_cut_by_the_table():
    import json

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert _cut_of(spec) == "words"
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    split["pattern"]["Regex"] += "|x"
    assert _cut_of(spec) is None
    assert _cut_of({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE"}}) == "spaces"
    assert _cut_of({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}, "model": {"type": "BPE"}}) is None


def test_coder_with_sentencepiece():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    texts = ["", "a b", "été 日本\n"]
    assert list(ChunkCoder(path, False).encode(texts)) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]


@pytest.mark.parametrize("sizes", [[1], [64] * 3, [4096], [4097, 9000], [], None])
def test_packer(sizes):
    rng = random.Random(1)
    sizes = [rng.choice((rng.randint(1, 90), rng.randint(1, 30))) for _ in range(800)] if sizes is None else sizes
    capacity = 64 if max(sizes, default=0) < 100 else 4096
    packer, windows = Packer(capacity, most_open=8), []
    for doc, n in enumerate(sizes):
        windows += packer.add(doc, np.arange(n, dtype="<u4").tobytes())
        assert packer.counts.sum() == packer.n_open <= 9
    windows += packer.finish()
    fills = [sum(len(ids) // 4 for _, _, ids in w) for w in windows]
    assert all(0 < f <= capacity for f in fills) and sum(f < capacity for f in fills) <= 1
    pieces = sorted((doc, start, ids) for w in windows for doc, start, ids in w)
    for doc, group in itertools.groupby(pieces, key=lambda p: p[0]):
        at = 0
        for _, start, ids in group:
            assert start == at and np.frombuffer(ids, "<u4")[0] == start
            at += len(ids) // 4
        assert at == sizes[doc]
    assert {p[0] for p in pieces} == set(range(len(sizes)))


def test_packer_takes_the_level_of_least_squares():
    rng = random.Random(3)
    packer = Packer(32, most_open=10_000)
    for _ in range(300):
        size = rng.randint(1, 31)
        before = packer.counts.copy()

        def squares(level, size=size, before=before):
            after = before.copy()
            after[level] -= level > 0
            if level + size < 32:
                after[level + size] += 1
            return int((after**2).sum())

        levels = [0, *(h for h in range(1, 32 - size + 1) if before[h])]
        list(packer.add(0, bytes(4 * size)))
        assert int((packer.counts**2).sum()) == min(map(squares, levels))


def test_jpeg_round_trip():
    rng = np.random.default_rng(0)
    matrices = [rng.integers(0, 256, (n, 64)).astype(np.uint8) for n in (1, 2, 9, 50)] + [np.zeros((3, 64), np.uint8), np.full((3, 64), 255, np.uint8)]
    for m, back in zip(matrices, jpeg.thumbnails(jpeg.write_grey(matrices)), strict=True):
        assert (m == back).all()
    payload = media.payload_of("x" * 3_000_001)
    (blob,) = jpeg.write_payloads([payload])
    assert jpeg.thumbnails([blob])[0].tobytes()[: jpeg.payload_length(blob, 1 << 30)] == payload
    assert len(media.payload_of("")) == 64 == len(media.payload_of("a" * 64)) and len(media.payload_of("é" * 33)) == 128


def test_payloads_beyond_one_picture(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jpeg, "_MOST_BLOCKS", 70)
    rng = random.Random(9)
    texts = ["a" * 4480, "a" * 4481, "".join(chr(rng.randrange(1, 0x250)) for _ in range(100_000)), "short"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["id", "text"])
    stored = list(media._encode(iter([batch])))
    blobs = [m for b in stored for m in b.column(2).to_pylist()]
    assert [len(jpeg.parse_all(m)) for m in blobs] == [1, 1, 5, 1] and len(jpeg.parse_all(blobs[2] + blobs[0])) == 5
    rows = [r for b in media._digests(iter(stored)) for r in b.to_pylist()]
    for r, t in zip(rows, texts, strict=True):
        assert r["payload_sha256"] == hashlib.sha256(media.payload_of(t)).hexdigest()
    width, height, wide, high, _, _ = media._features([blobs[2]])[0]
    assert (width, height) == (8 * wide, 8 * high)


def test_jpeg_with_ac_colour_and_no_restarts():
    """A file of three components with 2x2 sampling, AC codes and zero runs, written bit by bit."""
    dc, ac = {0: (0b0, 1), 3: (0b10, 2)}, {0x00: (0b0, 1), 0x01: (0b10, 2), 0xF0: (0b110, 3), 0x12: (0b1110, 4)}

    def table(codes):
        return bytes(sum(n == k for _, n in codes.values()) for k in range(1, 17)) + bytes(s for s, _ in sorted(codes.items(), key=lambda x: x[1][1]))

    rng = random.Random(5)
    bits, want, last = "", [], [0, 0, 0]

    def put(code):
        return format(code[0], f"0{code[1]}b")

    for _ in range(2 * 2):
        for comp, blocks in ((0, 4), (1, 1), (2, 1)):
            for _ in range(blocks):
                diff = rng.choice((0, 5, -6))
                last[comp] += diff
                if comp == 0:
                    want.append(last[0])
                bits += put(dc[0]) if diff == 0 else put(dc[3]) + format(diff if diff > 0 else diff + 7, "03b")
                bits += rng.choice(("", put(ac[0xF0]), put(ac[0x01]) + "1", put(ac[0x12]) + "01" + put(ac[0x01]) + "0")) + put(ac[0x00])
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes((8, 0, 30, 0, 25, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    scan = bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))
    blob = b"\xff\xd8" + jpeg._segment(0xDB, bytes((0,)) + bytes((16,)) * 64) + jpeg._segment(0xC0, frame) + jpeg._segment(0xC4, b"\x00" + table(dc)) + jpeg._segment(0xC4, b"\x10" + table(ac)) + jpeg._segment(0xDA, scan) + data + b"\xff\xd9"
    (light,) = jpeg.thumbnails([blob])
    grid = np.array(want).reshape(2, 2, 2, 2).transpose(0, 2, 1, 3).reshape(4, 4)
    assert (light == np.clip(np.rint(grid * 2) + 128, 0, 255)).all() and light.shape == (4, 4)


@pytest.mark.parametrize("blob", [b"", b"\xff\xd8", b"\xff\xd8\xff\xda\x00\x02", b"nothing", b"\xff\xd8\xff\xc2\x00\x11" + bytes(15)])
def test_broken_jpeg(blob):
    assert media._features([blob, None]) == [(None,) * 6] * 2


def plain_shingles(text, n=5):
    w = text.encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def test_shingles_and_filters():
    rng = random.Random(2)
    shingler = Shingler(5)
    texts = [" ".join(rng.choice("abCcd") for _ in range(rng.randint(0, 14))) for _ in range(120)] + ["A\x0bb\x1cc d\te f", "Éa éa"]
    sets = [plain_shingles(t) for t in texts]
    arrays = [shingler.shingles(t).astype(np.int64) for t in texts]
    arrays = [np.sort(a) for a in arrays]
    assert [len(s) for s in sets] == [len(a) for a in arrays]
    for (s, a), (t, b) in itertools.combinations(zip(sets, arrays, strict=True), 2):
        common = len(s & t)
        assert suffix_bound(a, b, 3) >= common == len(np.intersect1d(a, b))
        truth = bool(s and t) and 100 * common >= 80 * len(s | t)
        if s and t:
            assert linked(a, b, 80) == truth
        if truth:
            assert common >= pair_overlap(len(s), len(t), 80)
            assert set(a[: prefix_length(len(a), 80)]) & set(b[: prefix_length(len(b), 80)])


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(4)
    model = fit_language_model(["aa bb", "cc dd", "ee ff"], ["x", "y", "z"], switch_penalty=3.0)
    labeller = Labeller(model)
    for _ in range(60):
        s = -rng.exponential(2.0, (rng.integers(1, 7), 3))
        best = max(itertools.product(range(3), repeat=len(s)), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in itertools.pairwise(p)))
        found = labeller._path(s)
        got = [int(s.sum(0).argmax())] * len(s) if found is None else found.tolist()
        value = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in itertools.pairwise(p))
        assert abs(value(got) - value(best)) < 1e-9


def test_word_scores_equal_looking_trigrams_up():
    rng = random.Random(7)
    word = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randint(1, 6)))
    learned = [[word() for _ in range(9000)] for _ in range(3)]
    model = fit_language_model([" ".join(w) for w in learned], ["x", "y", "z"])
    words = sorted({w for part in learned for w in part} | {word() for _ in range(20000)})
    labeller = Labeller(model)
    list(labeller.label_all([" ".join(words)]))
    for w in words:
        s = sum((model.gram_scores[model.gram_rows[g]] for g in grams(w) if g in model.gram_rows), np.zeros(3))
        assert np.allclose(labeller.words.scores[labeller.words[w]], np.maximum(s - s.max(), -8.0))


def test_language_scripts_and_edges():
    model = fit_language_model(["the and of " * 9, "привет мир да " * 9, "le la les des " * 9], ["en", "ru", "fr"])
    found = list(Labeller(model, most_kept=3).label_all([None, "", "12 --", "мир", "the of and", "the of and the of and привет мир привет мир да да", "λόγος"]))
    assert [f[0] for f in found[:5]] == ["und", "und", "und", "ru", "en"]
    assert [s[0] for s in found[5][2]] == ["en", "ru"] and found[5][2][0][2] == 6
    assert found[6][0] in ("en", "fr", "ru") and all(0 <= f[1] <= 1 for f in found)
    assert [f[0] for f in Labeller(fit_language_model([], [])).label_all(["text", None])] == ["und", "und"]


def plain_label(model, text):
    """Every word scored by looking its trigrams up one by one; every step of the best path done."""
    if not model.languages:
        return "und", 0.0, []
    rows, weights = [], []
    for token in (text or "").split():
        word = letters_of(token)
        s = np.zeros(len(model.languages))
        for g in grams(word):
            if g in model.gram_rows:
                s = s + model.gram_scores[model.gram_rows[g]]
        allowed = model.scripts.get(script_of(word[0])) if word else None
        if allowed is not None and allowed.any():
            s = np.where(allowed, s, s.min() - 8.0)
        rows.append(np.maximum(s - s.max(), -8.0) if word else np.zeros(len(s)))
        weights.append(len(word))
    if not sum(weights):
        return "und", 0.0, []
    best, came = rows[0].copy(), []
    for row in rows[1:]:
        moves = best[:, None] - model.switch_penalty * (1 - np.eye(len(best)))
        # staying comes before switching, of other languages the first
        step = [int(k) if best[k] >= moves[:, k].max() - 1e-12 else int(moves[:, k].argmax()) for k in range(len(best))]
        came.append(step)
        best = np.array([moves[s, k] for k, s in enumerate(step)]) + row
    path = [int(best.argmax())]
    for step in reversed(came):
        path.append(step[path[-1]])
    path.reverse()
    held = np.bincount(path, weights, len(best))
    top = int(held.argmax())
    margin = sum(r for r, p in zip(rows, path, strict=True) if p == top)
    rivals = [m for k, m in enumerate(margin) if k != top]
    share = held[top] / held.sum()
    score = share / (1 + math.exp(min(max(rivals) - margin[top], 50.0))) if rivals else share
    return model.languages[top], score, [model.languages[p] for p in path]


def test_language_equals_plain_version():
    rng = random.Random(12)
    pools = {"en": "the of and house river walked into".split(), "de": "der die und haus fluss ging hinein".split(), "ru": "мир дом река шёл туда".split(), "fr": "le la les maison fleuve entra".split()}
    learn = [(" ".join(rng.choice(pools[g]) for _ in range(30)), g) for g in pools for _ in range(20)]
    model = fit_language_model([t for t, _ in learn], [g for _, g in learn], switch_penalty=4.0)
    texts = [None, "", " 12 --", "мир house", "λόγος", "x"]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [rng.choice(pools[rng.choice(list(pools))] if rng.random() < 0.1 else pool) for pool in [pools[rng.choice(list(pools))]] for _ in range(rng.randint(1, 12))]
        texts.append(" ".join(w + rng.choice(("", ",", "!", "q")) for w in words))
    differ = 0
    for text, (lang, score, spans) in zip(texts, Labeller(model).label_all(texts), strict=True):
        want = plain_label(model, text)
        path = [g for g, a, b in spans for _ in range(b - a)]
        differ += path != want[2]  # ties between paths may be broken otherwise
        if path == want[2]:
            assert lang == want[0] and abs(score - want[1]) < 1e-9, text
    assert differ <= 2


def plain_quality(model, vectors, v):
    cos = np.round(np.array([sum(float(a) * float(b) for a, b in zip(v, w, strict=True)) for w in vectors]), 5)
    last = sorted(cos, reverse=True)[min(model.neighbours, len(cos)) - 1]
    votes = [(math.exp(model.sharpness * (c - 1)), y) for c, y in zip(cos, model.labels, strict=True) if c >= last]
    return sum(w * y for w, y in votes) / sum(w for w, _ in votes)


def test_quality_equals_plain_version():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Loud!!", "***", "12|34", "x-y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += texts[:10] * 3  # voters with copies: ties
    labels = [rng.randint(0, 1) for _ in texts]
    model = fit_quality_model(texts, labels, dims=12, neighbours=7, n_words=64)
    make = Vectors(model)
    asked = texts[:20] + [" ".join(rng.choice(words) for _ in range(5)) for _ in range(30)]
    got, _ = score_texts(make, asked)
    tied = 0
    for t, g in zip(asked, got, strict=True):
        (v,) = make.latent(make.counts([t]))
        tied += abs(plain_quality(model, model.vectors, v) - g) > 2e-4
    assert tied <= 1  # a cosine may round to either side


def test_quality():
    assert shape("Thnd***") == "Aa*" and shape("ÉÀé12!!") == "Aa0!"
    good, bad = [f"word{i} some plain text here" for i in range(30)], [f"WORD{i}!! SHOUT!! MORE!!" for i in range(30)]
    model = fit_quality_model(good + bad + [None, ""], [1] * 30 + [0] * 30 + [1, 0], dims=8)
    score, _ = score_texts(Vectors(model), ["quite plain words", "LOUD!! WORDS!!", None, "", "  \n"])
    assert score[0] > 0.7 > score[1] and score[2] == score[3] == score[4] == model.base
    empty = fit_quality_model([], [])
    assert score_texts(Vectors(empty), ["a", None])[0].tolist() == [0.5, 0.5]


def test_remove_covered():
    assert remove_covered("a\n\nb\nc\nd\n", [1]) == ("a\n\n", 4, 3)
    assert remove_covered("a\nb\nc", [0]) == ("", 3, 3)
