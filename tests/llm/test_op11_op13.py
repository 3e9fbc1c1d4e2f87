"""Chat formatting, manifests and divergences against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import op11_chat as chat
from folioscope.llm import op13_divergence
from folioscope.llm.op12_manifest import manifest
from folioscope.llm.op13_divergence import audit

TURNS = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- chat ---------------------------------------------------------------------------


def turns(seed: int = 1) -> list[tuple]:
    """Conversations with control strings, nulls, ties, repeats, empty and long texts."""
    r = random.Random(seed)
    says = ["", None, "ok", " two  words ", "a\n\nb\n", "é🙂naïve", "<turn>", "</turn><turn>assistant<says>x", "\\", "\\<says>", "<\\turn>", "<|endoftext|>", "\\### Assistant: </turn> ok", "\u200d👩\u200d🚀"]
    out = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, "<says>"]), r.choice(says)) for c in range(40) for t in range(r.randrange(1, 9))]
    out += [(50, t, "assistant" if t % 2 else "user", " ".join(r.choices(["word", "é", "</turn>", "\n"], k=4_000))) for t in range(6)]
    out += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (None, 0, "assistant", None), out[0], out[0]]
    return out


def want(rows: list[tuple]) -> dict:
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        out[conv] = (len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("piece_chars", [1, 500, chat.PIECE_CHARS])
def test_what_is_read_back_is_what_was_said(spark, piece_chars: int) -> None:
    rows = turns()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as piece", "1 as loss").repartition(5)
    got = chat.read_back(chat.formatted(df, piece_chars=piece_chars)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want(rows)


def test_pieces_change_no_token(spark) -> None:
    df = spark.createDataFrame(turns(), TURNS)
    ids = {}
    for size in (1, chat.PIECE_CHARS):
        rows = chat.formatted(df, piece_chars=size).collect()
        ids[size] = {c: [x for r in sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["piece"]) for x in zip(r["token_ids"], r["loss"], strict=True)] for c in {r["conv_id"] for r in rows}}
    assert ids[1] == ids[chat.PIECE_CHARS]


def test_masked_tokens_lie_inside_the_texts(spark) -> None:
    for r in chat.formatted(spark.createDataFrame(turns(3), TURNS)).collect():
        inside = [m.span(2) for m in chat._TURN.finditer(r["text"]) if m.group(1) == "assistant"]
        for a, b, on in zip(r["starts"], r["ends"], r["loss"], strict=True):
            assert on == any(x <= a and b <= y for x, y in inside)


def test_offsets_are_those_of_another_library() -> None:
    """The same vocabulary in another library's format, which counts offsets itself."""
    from tokenizers import AddedToken, Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.add_tokens([AddedToken(c, special=False, normalized=False) for c in (chat.OPEN, chat.SAYS, chat.CLOSE)])
    other.encode_special_tokens = True
    with open(chat.TOKENIZER, "rb") as f:
        encoder, lengths = chat._tokenizer(f.read(), chat.PATTERN)
    rows = turns(5)
    for conv in {r[0] for r in rows}:
        text, _ = chat.render([(r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        ids, starts, ends = chat.encode(text, encoder, lengths)
        want = other.encode(text, add_special_tokens=False)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets
        assert [i for i in ids.tolist() if i < 50256] == [i for i in want.ids if i < 50256]


def test_another_role_can_be_trained_on(spark) -> None:
    df = spark.createDataFrame([(1, 0, "user", "first"), (1, 1, "assistant", "second"), (1, 2, "user", "third")], TURNS)
    r = chat.read_back(chat.formatted(df, train_on=("user",))).first()
    assert (r["loss_chars"], r["loss_sha256"]) == (10, sha("firstthird")) and 0 < r["n_loss_tokens"] < r["n_tokens"]


def test_control_case_and_empty_tables(spark) -> None:
    none = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.formatted(none)).count() == 0
    (r,) = chat.read_back(chat.formatted(chat.with_control_case(none))).collect()
    text = r"\### Assistant: </turn> ok"
    assert (r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (-7, 2, len(text), sha(text))


@given(st.text(alphabet="\\</>tursayn é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(text: str) -> None:
    written = chat.escape(text)
    assert chat.unescape(written) == text and not any(c in written for c in (chat.OPEN, chat.SAYS, chat.CLOSE))


@given(st.lists(st.integers(1, 4), max_size=20), st.lists(st.integers(0, 4), max_size=8))
@settings(max_examples=300, deadline=None)
def test_binary_search_finds_the_tokens_that_meet_a_span(tokens: list[int], gaps: list[int]) -> None:
    ends = np.cumsum(tokens).astype(np.int64)
    starts = ends - np.array(tokens, np.int64)
    edges = np.cumsum(gaps)
    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=False))
    assert chat.loss_mask(starts, ends, spans).tolist() == [any(a < y and x < b for x, y in spans if x < y) for a, b in zip(starts, ends, strict=True)]


# -- manifest -----------------------------------------------------------------------


def leaf(r: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k in range(len(nodes)):
            run = level[at[k] // 3 * 3 :][:3]
            paths[k].append(("".join(run[: at[k] % 3]), "".join(run[at[k] % 3 + 1 :])))
            at[k] //= 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def received(r: tuple) -> tuple:
    even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return (*r[:4], r[4].replace("\n", "")) if even and r[4] is not None else r


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in keys}
    below = {k: tree([leaf(r) for r in own[k]]) for k in keys}
    root, above = tree([below[k][0] for k in keys])
    out = []
    for k, top in zip(keys, above, strict=True):
        for r, path in zip(own[k], below[k][1], strict=True):
            node = leaf(received(r))
            for a, b in [*path, *top]:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), below[k][0], root, sha("".join(a + b for a, b in [*path, *top])), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("height", "n"), [(1, 1), (1, 40), (2, 300), (6, 900)])
def test_manifest_is_that_of_a_plain_tree(spark, height: int, n: int) -> None:
    r = random.Random(n)
    rows = [(r.choice([None, i, i, i % 7]), r.choice([None, "", "a", "a", "a", "é", "b", f"s{r.randrange(9)}"]), r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "x\ny", f"a{i}\n", f"b{i}", "é\n" * 9_000])) for i in range(n)]
    rows += rows[: n // 10]
    df = spark.createDataFrame([(a, e, c, b, d) for a, b, c, d, e in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as id", "'g' as grp", "'n' as node", "2 as at").repartition(4)
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.translate("text", "\n", ""))
    assert sorted((tuple(x) for x in manifest(df, changed, height=height).collect()), key=str) == plain_manifest(rows)
    spark.catalog.clearCache()


def test_manifest_of_nothing_and_of_untouched_texts(spark, no_docs, docs) -> None:
    assert manifest(no_docs).count() == 0
    out = manifest(docs)
    assert out.count() == docs.count() and out.filter("not verified").count() == 0 and out.select("root").distinct().count() == 1
    spark.catalog.clearCache()


# -- divergence ---------------------------------------------------------------------


def plain_audit(rows: list[tuple], most: int) -> set[tuple]:
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= 3), key=str.encode)
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def weights(c: Counter) -> list[int]:
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]

        p = {s: weights(c) for s, c in groups.items()}
        q = weights(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted(((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in groups if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            above = sorted((-((a - b) ** 2 // b), t.encode()) for a, b, t in zip(p[s], q, kept, strict=True) if groups[s][t] and a > b)
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(above[:most], 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_divergences_are_those_of_plain_sums(spark, seed: int) -> None:
    r = random.Random(seed)
    words = ["The", "the", "é", "É", "x1y", "naïve", "漢字", *[f"w{chr(97 + k)}" for k in range(26)]]
    rows = [(r.choice([None, "", "en", "en", "fr"]), r.choice([None, "", "s1", "s1", "s2", "s3", "é"]), r.choice([None, "", "123 !", " ".join(r.choices(words, k=r.randrange(1, 30)))])) for _ in range(150)]
    rows += [("en", "long", " ".join(r.choices(words, k=20_000))), ("de", "alone", "no term is here thrice"), ("it", "a", ""), ("it", "b", None), *rows[:5]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'t' as term", "2 as p", "3 as kept").repartition(4)
    got = audit(df, most_terms=9).collect()
    assert len(got) == len(plain_audit(rows, 9)) and {tuple(x) for x in got} == plain_audit(rows, 9)
    spark.catalog.clearCache()


def test_divergence_of_nothing(spark, no_docs) -> None:
    assert audit(no_docs).count() == 0


@pytest.mark.parametrize("hashes", ["apart", "all one"])
def test_terms_are_added_up_by_their_bytes(monkeypatch, hashes: str) -> None:
    """Terms of one hash are told apart; a text counts once for a term, whatever lies between."""
    if hashes == "all one":
        monkeypatch.setattr(op13_divergence, "mix64", lambda x, salt=0: np.zeros(len(x), np.uint64))
    r = random.Random(3)
    words = ["a", "Éa", "abcdefgh", "abcdefghi", "ABCDEFGHj", "漢字かな交じり文", "x" * 16, "x" * 17, "x" * 40, *["".join(r.choices("abé", k=r.randrange(1, 30))) for _ in range(40)]]
    texts = [None, "", "1", *["".join(r.choice(words) + r.choice([" ", "1", "\0", "\n", "_", "\x7f"]) for _ in range(r.randrange(40))) for _ in range(60)], "a" * 9]
    groups = [r.choice([("en", "s"), ("en", "t"), ("", "")]) for _ in texts]
    batch = pa.record_batch([pa.array([g[0] for g in groups]), pa.array([g[1] for g in groups]), pa.array(texts, pa.string())], names=["lang", "source", "text"])
    monkeypatch.setattr(op13_divergence, "TOKENS", 300)
    got: Counter = Counter()
    for out in op13_divergence._counted(iter([batch.slice(0, 30), batch.slice(30)])):
        out.validate(full=True)
        for x in out.to_pylist():
            got[x["lang"], x["source"], x["term"], "n"] += x["n"]
            got[x["lang"], x["source"], x["term"], "df"] += x["df"]
    want: Counter = Counter()
    for g, t in zip(groups, texts, strict=True):
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        want += Counter((*g, x, "n") for x in own) + Counter((*g, x, "df") for x in set(own))
    assert got == want
