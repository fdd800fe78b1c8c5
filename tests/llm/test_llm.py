"""The operators on text: against brute force, exact round trips, and their edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tiktoken")
from annalist.llm.conversations import conversations, kahn, role_rank, visible
from annalist.llm.mixing import fit_softmax, mix_documents, posteriors, shares
from annalist.llm.packing import pack, pack_group
from annalist.llm.pii import Scanner, find_mentions, mask_mentions, masked, normal_form
from annalist.llm.splitting import Splitter, segments, split_texts
from annalist.llm.tokens import default_vocabulary, encoder, with_tokens

TERMS = [(g, "given") for g in ("Velric", "Velisa", "Velette", "Marric", "Marisa", "Tororin", "砚秋")] + [(f, "family") for f in ("Ashby", "Ashholt", "Dunby", "Dunholt", "Kestby", "Kestmere", "Dunmere", "Ashmere", "岑")]

FOUND = [
    ("write to a.b+c@mail.example.org now", ["email"]),
    ("write to a.b (at) mail [dot] example (dot) org now", ["email"]),
    ("ｗrite a＠mail．example to velric at mail dot example dot org", ["email", "email"]),
    ("pinned parser@1.0.0 and tool@4.5.dev, ask @tool", []),
    ("call +1 415 555 0167 or 212.555.0197 ext. 12, (020) 7946 0882", ["phone"] * 3),
    ("电话（０１０）５５５０ １５２２。", ["phone"]),
    ("tel five five five zero one two three", ["phone"]),
    ("Ruf mich unter 0049 40 66969530 an", ["phone"]),
    ("run id 2026051-165672 took 0045796 rows, budget 8718-1134 tokens, version 10.75.01.90", []),
    ("Passport no. C58304271, SSN 935-21-3493, trace 998562195503260521 closed", ["id_number", "id_number"]),
    ("身份证号99819319811011444X。", ["id_number"]),
    ("passeport n° 59CC67102; Numéro de sécurité sociale : 1 26 05 61 964 301 54", ["id_number"] * 2),
    ("Steuer-ID 17 321 445 594", ["id_number"]),
    ("I live at Flat 3, 128 Brindle Lane, Ostrelle. avenue 2 of the plan", ["address"]),
    ("Ich wohne Am Copperasplatz 201. J'habite au 84, impasse du Saltern.", ["address"] * 2),
    ("我住在栖川市青石路120号1栋189室。", ["address"]),
    ("My office is in Perrowick now.", []),
    ("Signed, Velric K. Dunmere; Ashby, Marisa; M. Kestby; Mr. Unseen", ["name"] * 4),
    ("VELRIC DUNHOLT and Velisa Dunby-Ashmere and Kestmere, Tororin", ["name"] * 3),
    ("the Velric index was rebuilt on branch marisa-fix", []),
    ("昨天岑砚秋提交了说明。我叫Velette Ashby。", ["name", "name"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "kinds"), FOUND)
def test_mentions(text, kinds):
    found = Scanner(TERMS).mentions(text)
    assert [k for k, _, _ in found] == kinds
    out, at = masked(text, found), 0
    for kind, a, b in found:  # all but the mentions is as it was
        piece = text[at:a] + f"[{kind.upper()}]"
        assert out.startswith(piece)
        out, at = out[len(piece) :], b
    assert out == text[at:]


def test_normal_form_maps_back():
    text = "x​y (at) z [dot] dev five five five one two six seven"
    norm, spans = normal_form(text)
    assert norm == "xy@z.dev 5551267" and len(spans) == len(norm)
    assert text[slice(*spans[norm.index("@")])] == " (at) " and text[slice(*spans[-1])] == "seven"


def test_mentions_of_a_table(spark):
    long = "no one. " * 20_000 + "mail a@b.example"
    rows = [("1", "a@b.example c@d.example", "x"), ("1", "a@b.example c@d.example", "x"), ("2", None, "x"), (None, "a@b.example", "x"), ("3", long, "x"), ("4", "", "x")]
    texts = spark.createDataFrame(rows, "id string, text string, kind string")
    got = sorted(map(repr, ((r.id, r.kind, r.nth) for r in find_mentions(texts, TERMS).collect())))
    assert got == sorted(map(repr, [("1", "email", 1), ("1", "email", 2)] * 2 + [(None, "email", 1), ("3", "email", 1)]))
    assert [r.text for r in mask_mentions(texts, TERMS).collect()][2:4] == [None, "[EMAIL]"]
    assert find_mentions(texts.limit(0), TERMS).count() == mask_mentions(texts.limit(0), TERMS).count() == 0


def test_roles_and_blanks(spark):
    rows = [("USER ", " ​\xa0"), ("助手", "x"), ("Human", None), ("developer", ""), ("function", "霁"), ("??", "﻿"), (None, "ㅤ")]
    got = spark.createDataFrame(rows, "r string, t string").select(role_rank("r").alias("r"), visible("t").alias("v")).collect()
    assert [x.r for x in got] == [1, 3, 1, 0, 2, None, None] and [x.v for x in got] == [False, True, False, False, True, False, False]


def test_kahn_leaves_cycles():
    turns = [((1, 0, "a"), "a", None), ((3, 0, "b"), "b", "a"), ((2, 0, "c"), "c", "d"), ((4, 0, "d"), "d", "c"), ((0, 0, "e"), "e", "b")]
    assert kahn(turns) == [0, 1, 4]
    assert kahn([((2, 0, "a"), "a", "gone"), ((1, 0, "b"), "b", "a")]) == [0, 1]


def some_turns(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for s in range(12):
        t = 0
        for i in range(r.choice([0, 1, 2, 4, 6, 30])):
            t += r.choice([0, 1, 5])
            rank = (1, 3)[i % 2] if r.random() < 0.97 else r.choice([0, 2, None])
            out.append((f"s{s}", f"e{s}-{r.randrange(10**6)}-{i}", t, rank, None, r.random() < 0.004, "more"))
    return [*out, (None, "x", 1, 1, None, False, ""), ("s0", None, 1, 1, None, False, ""), ("s0", "y", None, 1, None, False, "")]


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 10**6), (3, 10), (4, 10), (5, 4)])
def test_conversations(spark, seed, hot):
    turns = some_turns(seed)
    df = spark.createDataFrame(turns, "session_id string, event_id string, at_us bigint, rank int, reply_to string, missing boolean, extra string")
    want = []
    for s in {t[0] for t in turns} - {None}:
        own = sorted((t[2], -1 if t[3] is None else t[3], t[1]) for t in turns if t[0] == s and t[1] and t[2] is not None and not t[5])
        talk = [t[1] for t in own if t[1] in (1, 3)]
        whole = talk and talk[0] == 1 and talk[-1] == 3 and (1, 1) not in set(zip(talk, talk[1:])) and all(t[1] >= 0 for t in own)
        if whole and not any(t[0] == s and t[5] for t in turns):
            want += [(s, n, t[2]) for n, t in enumerate(own, 1)]
    assert sorted(map(tuple, conversations(df, hot_rows=hot, shards=4).collect())) == sorted(want)


@pytest.mark.parametrize("hot", [10**6, 5])
def test_replies_decide_the_order(spark, hot):
    chain = [(f"e{i}", 100 - i) for i in range(20)]  # each replies to the one before, though its clock is earlier
    rows = [("s", e, at, (1, 3)[i % 2], f"e{i - 1}" if i else None, False) for i, (e, at) in enumerate(chain)]
    cycle = [("c", "a", 1, 1, "b", False), ("c", "b", 2, 3, "a", False)]
    df = spark.createDataFrame(rows + cycle, "session_id string, event_id string, at_us bigint, rank int, reply_to string, missing boolean")
    got = sorted(map(tuple, conversations(df, hot_rows=hot, shards=3).collect()), key=lambda r: r[1])
    assert [r[2] for r in got] == [e for e, _ in chain]
    assert conversations(df.limit(0)).count() == 0


def test_long_chains_of_replies_and_cycles_over_shards(spark):
    r = random.Random(3)
    chain = [(f"e{i:03}", r.randrange(1000)) for i in range(120)]
    rows = [("s", e, at, (1, 3)[i % 2], f"e{i - 1:03}" if i else None, False) for i, (e, at) in enumerate(chain)]
    cycle = [("c", f"k{i}", 10 * i, (1, 3)[i % 2], f"k{(i + 1) % 30}", False) for i in range(30)]
    schema = "session_id string, event_id string, at_us bigint, rank int, reply_to string, missing boolean"
    for hot in ({"hot_rows": 10**6}, {"hot_rows": 7}):
        got = conversations(spark.createDataFrame(rows + cycle, schema), **hot).orderBy("turn_no").collect()
        assert [(x.session_id, x.event_id) for x in got] == [("s", e) for e, _ in chain]


def test_pack_group_best_fit():
    r = random.Random(1)
    items = [(r.randrange(0, 256), i) for i in range(3000)]
    out = pack_group(items, [64, 128, 256])
    used: dict[int, int] = {}
    size = {i: s for s, i in items}
    for i, b, s in out:
        used[b] = used.get(b, 0) + size[i]
    assert sorted(i for i, _, _ in out) == list(range(3000))
    assert all(used[b] <= s for _, b, s in out)
    final = {b: s for _, b, s in out}
    assert all(s == min(x for x in (64, 128, 256) if x >= used[b]) for b, s in final.items())
    assert sum(final.values()) - sum(used.values()) < 0.015 * sum(used.values())


def test_pack(spark):
    items = [(i, t, "x") for i, t in enumerate([0, None, 1, 255, 256, 257, 700, 5000])]
    specs = spark.createDataFrame([("a", 256), ("a", 100), ("b", 1000), ("none", 0), (None, 5)], "spec string, capacity_tokens int")
    df = spark.createDataFrame(items, "item_id bigint, tokens bigint, container string")
    for group in (2, 100):
        rows = pack(df, specs, group_items=group).collect()
        for spec, cap in (("a", 256), ("b", 1000)):
            own = [r for r in rows if r.spec == spec]
            for i, t, _ in items:
                parts = sorted((r.part, r.tokens) for r in own if r.item_id == i)
                n = max(1, -(-(t or 0) // cap))
                assert [p for p, _ in parts] == list(range(1, n + 1)) and sum(x for _, x in parts) == (t or 0)
            bins: dict[str, int] = {}
            for r in own:
                bins[r.container] = bins.get(r.container, 0) + r.tokens
                assert r.container_tokens in (256, 1000)
            assert all(bins[r.container] <= r.container_tokens <= cap for r in own)
        assert {r.spec for r in rows} == {"a", "b"}
    assert pack(df.limit(0), specs).count() == 0


TEXTS = st.lists(st.sampled_from(["word ", "Ende. ", "\n", "\n\n", "# H\n", "| a | b |\n", "```\n", "3.5", "中文。继续", "，无空格", "x" * 40, " 　\t", "\r\n", " ", "\x85", "don't ", "(a). B", "🎉", "\x1c", "12 345", "!?", "'s "]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([(12, 0), (16, 4), (30, 10), (64, 40)]))
def test_pieces_cover_and_fit(text, spec):
    splitter = Splitter(default_vocabulary())
    capacity, overlap = spec
    atoms = splitter.atoms(text).cut()
    for a, b, n in zip(atoms.starts, atoms.starts[1:], np.diff(atoms.upto), strict=False):
        assert splitter.count(text[a:b]) == n
    if atoms.total <= capacity:
        return
    at = 0
    for k, (begin, own, to, tokens, shared) in enumerate(splitter.split(atoms, capacity, overlap)):
        assert own == at and begin <= own < to
        assert splitter.count(text[begin:to]) == tokens <= capacity
        assert splitter.count(text[begin:own]) == shared <= overlap and (k or shared == 0)
        at = to
    assert at == len(text)


def test_boundaries():
    text = "# A\nOne. Two 3.5 here.\n\nNext line\nand one.\n| a |\n| b |\n# B\n好。再来"
    cut = {text[a:].strip()[:4]: s for a, s in segments(text)}
    assert cut == {"# A\n": 5, "One.": 3, "Two ": 2, "Next": 4, "and ": 3, "| a ": 2, "| b ": 2, "# B\n": 5, "好。再来": 3, "再来": 2}


def test_split_texts(spark):
    text = "\n".join(f"Line {i} says a little. It ends." for i in range(200))
    rows = [(1, text, "q"), (2, "short", "q"), (3, None, "q"), (4, "", "q"), (5, "汉" * 3000, "q"), (None, text, "q")]
    specs = spark.createDataFrame([("s", 128, 16), ("big", 10**6, 0), ("off", 0, 0), ("plain", 256, None)], "spec string, capacity_tokens int, overlap_tokens int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = split_texts(docs, specs).collect()
    assert {(r.doc_id, r.spec) for r in got} == {(d, s) for d in (1, 5, None) for s in ("s", "plain")}
    for d, t in ((1, text), (5, "汉" * 3000)):
        for spec in ("s", "plain"):
            own = sorted((r for r in got if (r.doc_id, r.spec) == (d, spec)), key=lambda r: r.piece_no)
            assert "".join(r.piece[r.own_char - r.from_char :] for r in own) == t
            assert all(t[r.from_char : r.to_char] == r.piece for r in own)
    assert all(r.shared_tokens == 16 for r in got if r.spec == "s" and r.doc_id == 1 and r.piece_no > 1)
    assert split_texts(docs.limit(0), specs).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello, world", 9), (2, None, 9), (3, "", 9)], "id bigint, text string, tokens int")
    assert {r.id: r.tokens for r in with_tokens(df, keep=("id",)).collect()} == {1: len(encoder(default_vocabulary()).encode("Hello, world")), 2: 0, 3: 0}


def test_softmax_on_held_out_rows():
    r = np.random.default_rng(1)
    y = r.integers(0, 3, 900)
    x = r.normal(size=(900, 20)).astype(np.float32) + 2.5 * np.eye(20, dtype=np.float32)[y]
    w = fit_softmax(x[:600], y[:600], 3)
    assert (posteriors(x[600:], w).argmax(axis=1) == y[600:]).mean() > 0.8


def test_mixing(spark):
    r = random.Random(2)
    words = {"a": "alpha beta gamma", "b": "uno dos tres", "c": "один два три"}
    rows = [(i, r.choice([s, f" {s.upper()} "]), " ".join(r.choices(words[s].split(), k=r.randrange(5, 80))), "z") for i, s in enumerate(r.choices("aabbc", k=900))]
    rows += [(9001, None, "alpha", "z"), (9002, "other", "beta", "z"), (9003, "a", "", "z"), (9004, "a", None, "z"), (None, "a", "beta", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, mix string")
    targets = spark.createDataFrame([("m", "a", 2.0, 1), ("m", "B ", 1.0, 3), ("m", "c", 1.0, 2), ("n", "a", 1.0, 1), ("n", "b", None, 5), ("n", "gone", 1.0, 2), ("n", "c", 3.0, 4)], "mix string, source string, target_weight double, max_repeats int")
    mix = mix_documents(docs, targets)
    table = mix.uses.cache().collect()
    limit = {("m", "a"): 1, ("m", "b"): 3, ("m", "c"): 2, ("n", "a"): 1, ("n", "c"): 4}
    assert all(0 < u.uses <= limit[u.mix, u.source] for u in table) and len({(u.mix, u.doc_id) for u in table}) == len(table)
    got = {(x.mix, x.source): x for x in shares(mix).collect()}
    for key, want in {("m", "a"): 0.5, ("m", "b"): 0.25, ("m", "c"): 0.25, ("n", "a"): 0.25, ("n", "c"): 0.75, ("n", "gone"): 0, ("n", "b"): 0}.items():
        assert abs(got[key].actual_share - want) < 0.01, (key, got[key])
        assert abs(got[key].expected_share - want) < 0.02, (key, got[key])
    assert any(u.doc_id == 9001 and u.source == "a" for u in table) and not any(u.doc_id == 9002 for u in table)  # without a source: by its text
    for parts in (1, 7):
        assert sorted(map(tuple, mix_documents(docs.repartition(parts), targets).uses.collect())) == sorted(map(tuple, table))
    assert got["n", "b"].wanted_share is None and got["n", "gone"].wanted_share == 0.2
    nothing = mix_documents(docs.limit(0), targets)
    assert nothing.uses.count() == 0 and shares(nothing).count() == 7


def test_overlaps_are_exact_where_a_beginning_makes_them_so():
    r = random.Random(9)
    splitter = Splitter(default_vocabulary())
    words = "retrieval isn't unbelievably counterrevolutionary they're überraschend 3.14159 检索延迟依然稳定 记住 naïve --- 😀😀 l'été".split()
    short = 0
    for _ in range(25):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "。", ". ", "\n", "\n\n", ""]) for _ in range(260))
        atoms = splitter.atoms(text).cut()
        for capacity, overlap in ((40, 7), (64, 16), (90, 45)):
            pieces = splitter.split(atoms, capacity, overlap)
            for before, (begin, own, to, tokens, shared) in zip(pieces, pieces[1:]):
                assert splitter.count(text[begin:to]) == tokens <= capacity and splitter.count(text[begin:own]) == shared
                if shared != overlap:
                    short += 1
                    assert all(splitter.count(text[b:own]) != overlap for b in range(before[0], own)), (text[begin:own], shared)
    assert short


def held_out_scores() -> dict[str, tuple[int, int, int]]:
    """Per kind: mentions there are, mentions found as they are, mentions found that aren't there."""
    from held_out import CASES

    scan = Scanner(TERMS).mentions
    out = {k: [0, 0, 0] for k in ("email", "phone", "id_number", "address", "name")}
    for text, want in CASES:
        got = [(k, text[a:b]) for k, a, b in scan(text)]
        for k in out:
            wanted, found = [m for x, m in want if x == k], [m for x, m in got if x == k]
            out[k][0] += len(wanted)
            out[k][1] += sum(m in found for m in wanted)
            out[k][2] += sum(m not in wanted for m in found)
    return {k: tuple(v) for k, v in out.items()}


def test_held_out_texts():
    scores = held_out_scores()
    assert all(found >= 0.75 * there and false <= 1 for there, found, false in scores.values()), scores
    assert sum(s[1] for s in scores.values()) >= 0.9 * sum(s[0] for s in scores.values()), scores
