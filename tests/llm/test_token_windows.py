from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from provenlake.llm import token_windows
from provenlake.llm._base import table

TEXTS = [
    "A plain sentence, with 12 numbers and some words.", "", None, "   leading and  double   spaces \n\n\tlines\r\n", "naïve café — “quotes” … ελληνικά 日本語の文 🙂🙂🏽",
    "<|endoftext|> <s> </s> <unk> <0x0A> are plain here", "has the mark ▁ inside", "\u0000 \u0007 control", "a" * 3000, " ", "\n", "word " * 4000, "x", "don't we'll I'm they've",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_windows.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{token_windows.TOKENIZERS}/piece_bpe_32k.model")


def brute(texts, tokenizers):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text: by byte ranges, without windows or memory."""
    a, b = tokenizers
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    rows = []
    for text in texts:
        want = b" " + (text or "").encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a.id_to_token(n)) for n in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode() for n in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append(None)
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            at = [0]
            for x in parts:
                at.append(at[-1] + len(x))
            ranges.append(list(zip(at[:-1], at[1:], strict=True)))
        shared = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, low = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(n) for n, (s, e) in zip(ids, spans, strict=True) if low <= s and e <= end) for ids, spans in zip((ids_a, ids_b), ranges, strict=True)) if len(text) < 200 else None)
            low = end
        over, first = [], 0
        for x, (s, e) in zip(ids_a, ranges[0], strict=True):
            while ranges[1][first][1] <= s:
                first += 1
            j = first
            while j < len(ids_b) and ranges[1][j][0] < e:
                over.append((x, ids_b[j]))
                j += 1
        rows.append((len(ids_a), len(ids_b), groups, over))
    held = Counter(p for r in rows if r for p in set(r[3]))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, over = r
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((n_a, n_b, len(groups), len(over), sum(held[p] == most[p[0]] for p in over), sum(held[p] for p in over), digest))
    return out


def found(frame):
    return {r.doc_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("part_pairs", [1 << 20, 7])
def test_statistics_against_brute_force(spark, tokenizers, part_pairs):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["ab", " ", "\n", "é", "The ", "ing", "1", "–", "  ", "ß", "漢"]) for _ in range(60)) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs int, row string")
    got = found(token_windows.link_statistics(frame, part_pairs=part_pairs))
    for i, want in enumerate(brute(texts, tokenizers)):
        assert got[i][:6] == want[:6], texts[i]
        if want[6] is not None:
            assert got[i][6] == want[6], texts[i]


def test_query_tables_against_brute_force(spark, sf_dir, tokenizers):
    docs = table(spark, sf_dir, "documents")
    got = found(token_windows.link_statistics(docs))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for (id, _), want in zip(rows, brute([t for _, t in rows], tokenizers), strict=True):
        assert got[id][:6] == want[:6]


def test_groups_cover_the_text(spark):
    files = token_windows.Vocabularies.read()
    aligner = token_windows.Aligner(files, memo_tokens=30)  # forgets all the time
    text = "some words, once more some words, and Unglaublichkeiten." * 5
    for _ in range(3):
        [(n_a, n_b, windows)] = aligner.documents([text.encode()])
        groups = b";".join(aligner.groups[n] for n in windows).decode().split(";")
        a = [int(n) for g in groups for n in g.split("|")[0].split(",")]
        b = [int(n) for g in groups for n in g.split("|")[1].split(",")]
        assert len(a) == n_a and len(b) == n_b
        assert b"".join(aligner.a_bytes[n] for n in a) == b" " + text.encode() == b"".join(aligner.b_bytes[n] for n in b)
        assert all(b"".join(aligner.a_bytes[int(n)] for n in g.split("|")[0].split(",")) == b"".join(aligner.b_bytes[int(n)] for n in g.split("|")[1].split(",")) for g in groups)


def test_hard_rows_and_empty_tables(spark, hard, empty):
    got = token_windows.link_statistics(hard)
    assert got.count() == hard.count() and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert token_windows.link_statistics(empty).isEmpty()
    assert token_windows.link_statistics(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()[0].n_a == 0
