"""Refusals: every variant counts, however rare, and every link of a bucket is seen."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cadenza.llm import pairtext as P
from cadenza.llm import pairtokens as K
from cadenza.llm.pairs import BANDS, SIMILARITY, _Inspector, broken_pairs, cluster_openings

SCHEMA = "pair_table string, pair_id bigint, question string, answer string, interrupted boolean"


def test_rare_variants_of_a_refusal(spark):
    items = ["red cup", "blue jar", "old clock", "tiny spoon"]
    rows = [("t", i, f"What is beside the {w}?", "I'm afraid I must decline to answer.", False) for i, w in enumerate(items)]
    rows += [
        ("t", 10, "Who opened the door?", "I'm afraid I must decline to answer at this t", False),
        ("t", 11, "Who closed the window?", "I'm afraid I must decline to answer at this time.", False),
        ("t", 12, "Who fed the cat?", "Someone I cannot tell apart from the others near the gate did that.", False),
    ]
    found = {r["pair_id"]: r["defect_type"] for r in broken_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: "refusal" for i in (0, 1, 2, 3, 10, 11)}


def _clauses(texts: list[str]) -> dict[str, tuple]:
    """text -> (h, shingles, bands) as the operator makes them of an answer with one clause."""
    out = {}
    for t in texts:
        for b in _Inspector().inspect(["t"], [0], ["?"], [t], [True]):
            if b.column("kind")[0].as_py() == 2:
                out[t] = tuple(b.column(c)[0].as_py() for c in ("pair_id", "hs", "ys"))
    return out


def _clustered(spark, made: dict[str, tuple], declining: set[str]) -> dict[int, int]:
    rows = [(h, t in declining, sh, bands) for t, (h, sh, bands) in made.items()]
    df = spark.createDataFrame(rows, "h bigint, declines boolean, shingles array<bigint>, bands array<bigint>")
    return {r["h"]: r["template"] for r in cluster_openings(df).collect()}


def test_links_beside_the_least_clause(spark):
    # In every bucket that b and c share, other clauses stand that are below 0.8 to both.
    words = [f"w{chr(97 + i)}" for i in range(26)]
    b, c = " ".join(words), " ".join([*words, "more"])
    others = [" ".join([*words[:j], "a", *words[j + 1 :]]) for j in range(4, 22)] + [" ".join(["a", "a", "a", *words[3:]])]
    made = _clauses([b, c, *others])
    shared = [k for k in range(BANDS) if made[b][2][k] == made[c][2][k]]
    assert shared and sum(any(made[o][2][k] == made[b][2][k] for o in others) for k in shared) > len(shared) / 2
    got = _clustered(spark, made, set(made))
    assert got[made[b][0]] == got[made[c][0]]
    assert len(set(got.values())) == len(made) - 1


def test_links_against_brute_force(spark):
    draw = random.Random(7)
    texts = set()
    for base in range(12):
        words = [f"b{base}x{draw.randrange(40)}" for _ in range(draw.randrange(10, 40))]
        for _ in range(20):
            changed = list(words)
            for _ in range(draw.randrange(0, 3)):
                changed[draw.choice([0, 1, -1, -2])] = f"y{draw.randrange(60)}"
            texts.add(" ".join(changed))
    made = _clauses(sorted(texts))
    sets = {t: set(sh) for t, (_, sh, _) in made.items()}
    names = sorted(made)
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= SIMILARITY * len(sets[a] | sets[b])]
    got = _clustered(spark, made, set(made))
    joined = sum(got[made[a][0]] == got[made[b][0]] for a, b in links)
    assert len(links) > 200 and joined >= 0.99 * len(links)
    # Nothing is joined but along links.
    root = {t: t for t in names}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for i, a in enumerate(names) for b in names[i + 1 :] if got[made[a][0]] == got[made[b][0]])


def test_only_what_is_linked_to_a_declining_clause_is_labelled(spark):
    a = "i am sorry to say that i can not help you with any of these questions today"
    near, far = a + " friend", "the red cup stands on the top shelf right beside the old clock from paris"
    made = _clauses([a, near, far])
    got = _clustered(spark, made, {a})
    assert set(got) == {made[a][0], made[near][0]} and len(set(got.values())) == 1


REFUSALS = [
    "I must pass on this one.", "This goes against my policies.", "Je ne peux pas répondre à cette question.", "No puedo ayudar con eso.",
    "Nein, dabei darf ich leider nicht helfen.", "这个我没法说。", "抱歉，这个问题我无法回答。", "I'm not able to share that information.",
]


def test_refusals_that_recur_in_any_language(spark):
    things = ["red cup", "blue jar", "old clock", "tiny spoon"]
    rows = [("t", 10 * i + k, {"这": "杯子在哪里？", "抱": "钟在哪里？"}.get(r[0], f"Where is the {t}?") + " " * k, r, False) for i, r in enumerate(REFUSALS) for k, t in enumerate(things)]
    rows = [(a, b, q if not r.startswith(("这", "抱")) else ["杯子在哪里？", "钟停了吗？", "谁开了门？", "猫吃了什么？"][b % 10], r, e) for a, b, q, r, e in rows]
    rows += [("t", 900 + k, f"Where is the {t}?", f"The {t} cannot be seen, but it is behind the door.", False) for k, t in enumerate(things)]
    found = {r["pair_id"]: r["defect_type"] for r in broken_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    # In another language than the question is the stronger finding.
    foreign = {10 * i + k for i, r in enumerate(REFUSALS) for k in range(4) if r.startswith(("Je", "No ", "Nein"))}
    assert found == {10 * i + k: "other_language" if 10 * i + k in foreign else "refusal" for i in range(len(REFUSALS)) for k in range(4)}


@pytest.mark.parametrize("answer", ["Чашка стоит на верхней полке.", "カップは棚の上にあります。", "컵은 선반 위에 있습니다.", "La tazza è sul tavolo accanto alla finestra.", "A xícara está na mesa e não no chão.", "De kop staat op het bureau, maar niet in de kast."])
def test_other_languages(answer):
    assert P.other_language("Where is the cup now?", P.plain(answer))
    assert not P.other_language(P.plain(answer), P.plain(answer))


def test_batches_tell_languages_as_single_texts_do():
    texts = ["Where is the cup?", "杯子在哪里？", "Okay. 锤子在窗台上。", "", "7", "Der Topf ist auf dem Herd.", "hammer", "La taza está en la mesa", "カップは棚", "don't know it's there", "好 the", "o a os", "Привет the"]
    texts = [P.plain(t).lower() for t in texts]
    told = K.languages(K.Tokens(texts))
    assert [P.LANGUAGES[k] for k in told.tolist()] == [P.language(t) for t in texts]


def test_copies_by_letters_are_no_fewer_than_by_reading():
    draw = random.Random(3)
    questions = ["Where did I leave the red hammer?", "窗台上一共有几个勺子？", "Who?", "What comes after I put the candle under the desk?"]
    answers = []
    for q in questions:
        for _ in range(60):
            letters = list(q)
            for _ in range(draw.randrange(0, 4)):
                i = draw.randrange(len(letters))
                letters[i : i + draw.randrange(0, 2)] = draw.choice("aeo x")
            t = "".join(letters)
            answers.append((q, draw.choice([t, t, "You asked: " + t, t + " " + t, t + " It is here.", q + q, "嗯，" + t])))
    size, bags = K.letter_bags([P.plain(a).lower() for _, a in answers] + [P.plain(q).lower() for q, _ in answers])
    n = len(answers)
    again, holds = K.may_repeat(size[n:], bags[n:], size[:n], bags[:n])
    for i, (q, a) in enumerate(answers):
        if P.question_copy(P.plain(q), P.plain(a)):
            assert again[i] or holds[i] and P.begins_again(P.plain(q), P.plain(a)), (q, a)


def test_long_and_odd_texts():
    made = list(_Inspector().inspect(["t"] * 4, [1, 2, 3, 4], [None, "\x00", "Where?", "Where?"], ["\x00\x00", "a " * 300_000, "\ud83d\ude00 ok", "…"], [False] * 4))
    assert made and sum(b.num_rows for b in made if b.num_rows) > 0
    assert np.all([b.schema == made[0].schema for b in made])
