from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import feistel
from cadenza.llm import piirules as R
from cadenza.llm.mixing import mix, shares
from cadenza.llm.packing import make_plan, pack, unused_room
from cadenza.llm.pii import pseudonym, redact, redact_documents
from cadenza.llm.tokens import count_tokens, encoder


# --- packing ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_plan_places_every_item_once(capacity):
    sizes = np.random.default_rng(capacity).integers(1, capacity + 1, 3000)
    plan = make_plan({int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}, capacity)
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[order] = np.arange(len(sizes)) - np.searchsorted(sizes[order], sizes[order])
    used = np.bincount(plan.locate(sizes, rank), weights=sizes, minlength=plan.n)
    assert len(used) == plan.n and used.max() <= capacity and used.min() > 0
    assert plan.n <= 1.03 * np.ceil(sizes.sum() / capacity) + 3
    assert make_plan({}, capacity).n == 0


def test_pack(spark):
    rows = [(i, s, "x") for i, s in enumerate([0, None, -3, 5, 10, 11, 25, 20, 5, 5, 5])]
    df = spark.createDataFrame(rows, "id bigint, n int, part string")
    out = pack(df, "id", "n", {"ten": 10, "big": 100})
    assert sorted(r["id"] for r in out.filter("container_id IS NULL AND container_kind = 'ten'").collect()) == [0, 1, 2]
    totals = {(r["container_kind"], r["id"]): r["n"] for r in out.groupBy("container_kind", "id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert all(totals[k, i] == max(0, s or 0) for k in ("ten", "big") for i, s, _ in rows)
    room = unused_room(out).collect()
    assert all(0 <= r["unused_tokens"] < r["capacity_tokens"] for r in room)
    assert sorted((r["part"], r["token_start"], r["n_tokens"]) for r in out.filter("id = 6 AND container_kind = 'ten'").collect()) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert out.filter("id = 5 AND container_kind = 'big'").count() == 1
    assert pack(df.limit(0), "id", "n", {"ten": 10}).count() == 0


def test_tokens(spark):
    text = "Hello world, 你好。 " * 3000
    df = spark.createDataFrame([("",), (None,), ("Hello world",), (text,)], "t string")
    got = [r[0] for r in df.select(count_tokens("t")).collect()]
    assert got[:3] == [0, 0, 2] and got[3] == len(encoder()(text))


# --- mixing ----------------------------------------------------------------------------------------
def test_mix_reaches_shares(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"), (F.col("id") % 37 + 1).alias("n"), (1 / (F.col("id") % 3 + 1)).alias("w"), F.lit(1).alias("rank"))
    odd = spark.createDataFrame([(9001, None, 5, 1.0, 1), (9002, "z", 5, 1.0, 1), (9003, "a", 0, 1.0, 1), (9004, "a", None, 1.0, 1)], "doc_id bigint, source string, n bigint, w double, rank int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 4), ("c", 0.25, 4), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    for weight in (None, F.col("w")):
        mixed = mix(docs.unionByName(odd), targets, "doc_id", "source", "n", weight)
        got = {r["source"]: r for r in shares(mixed, targets, "source").collect()}
        for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.25)):
            assert abs(got[s]["actual_share"] - share / 0.95) < 0.005
            assert got[s]["most_copies"] <= got[s]["max_repeats"]
        assert got["gone"]["size"] == 0
        assert mixed.filter("doc_id > 9000").count() == 0 and mixed.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert mix(docs.limit(0), targets, "doc_id", "source", "n").count() == 0


# --- personal information --------------------------------------------------------------------------
CASES = [
    ("write to Jo.Doe+x@mail.example.org.", [("email", "Jo.Doe+x@mail.example.org")]),
    ("mailto:jo at mail dot example", [("email", "jo at mail dot example")]),
    ("有问题请发邮件到jo_d [at] mail[dot]example。", [("email", "jo_d [at] mail[dot]example")]),
    ("cam2@30fps and @channel", []),
    ("call +1 (312) 555-0136 or 555-0120", [("phone", "+1 (312) 555-0136"), ("phone", "555-0120")]),
    ("手机：１３８ ００００ ０３１０", [("phone", "１３８ ００００ ０３１０")]),
    ("请打（0999）55506153", [("phone", "（0999）55506153")]),
    ("five five five zero one five two", [("phone", "five five five zero one five two")]),
    ("ticket 557935684, build 1.1.555.0166, barcode 8444 5714 7630, order 312-555", []),
    ("SSN 666-42-1553", [("identity_number", "666-42-1553")]),
    ("part no. 031-04-3823 fits", []),
    ("DNI 00038605-B", [("identity_number", "00038605-B")]),
    ("passport no. XK 9147900", [("identity_number", "XK 9147900")]),
    ("身份证994067195503254456，批次编号 997167199911111247", [("identity_number", "994067195503254456")]),
    ("I live at Flat 19, 197 Cooper Court, Northmere and wait", [("street_address", "Flat 19, 197 Cooper Court, Northmere")]),
    ("12 court lines; The Fennel Street scene", []),
    ("家住云溪市望渔区桂花巷61号2单元2407室，门铃坏了", [("street_address", "云溪市望渔区桂花巷61号2单元2407室")]),
    ("石桥路口的画面有点抖", []),
    ("Frau Kestmann wohnt Lindenstr. 32 b.", [("person_name", "Kestmann"), ("street_address", "Lindenstr. 32 b")]),
    ("Le colis part chez Jean Halombe, 41 avenue du Vieux Four.", [("person_name", "Jean Halombe"), ("street_address", "41 avenue du Vieux Four")]),
    ("El paseo duró 14 minutos. C/ Fuente Baja 158", [("street_address", "C/ Fuente Baja 158")]),
    ("联系人：闻人芮舟，电话", [("person_name", "闻人芮舟")]),
    ("Reviewed-by: Norton, Kofi (x)", [("person_name", "Norton, Kofi")]),
    ("Prof. A. Griesby and nobody", [("person_name", "A. Griesby")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "items"), CASES)
def test_find(text, items):
    assert [(k, text[a:b]) for k, a, b in R.find(text)] == items


def test_redact_keeps_the_rest():
    text = "Contact: Ewan Kestwick <ewan@x.example>, +1-415-555-0155. Bye " + "x" * 100_000
    new, items = redact(text)
    rest, at = [], 0
    for _, start, end, placeholder in items:
        assert placeholder in new
        rest.append(text[at:start])
        at = end
    assert len(items) == 3 and all(r in new for r in [*rest, text[at:]])


def test_pseudonyms_are_linked_and_valid():
    assert pseudonym("phone", "+1 415 555 0155") != pseudonym("phone", "+1 415 555 0156")
    assert pseudonym("phone", "+1 415 555 0155")[3:].replace(" ", "") == pseudonym("phone", "415-555-0155").replace("-", "")
    assert pseudonym("email", "A.b@x.example") == pseudonym("email", "a.b (at) x dot example")
    new = pseudonym("identity_number", "994067195503254456")
    assert R.china_check(new[:17]) == new[17] and date(int(new[6:10]), int(new[10:12]), int(new[12:14]))
    assert R.dni_letter(pseudonym("identity_number", "00038605-B")[:8]) == pseudonym("identity_number", "00038605-B")[-1]


@pytest.mark.parametrize("size", [1, 2, 10, 365, 10_000])
def test_feistel_is_a_permutation(size):
    some = range(min(size, 1000))
    out = [feistel.permute(v, size, b"k") for v in some]
    assert len(set(out)) == len(out) and all(0 <= v < size for v in out)
    assert [feistel.permute(v, size, b"k", back=True) for v in out] == list(some)


def test_redact_documents(spark):
    df = spark.createDataFrame([(1, "call 555-0120", "a"), (2, None, "b"), (3, "", "c"), (1, "call 555-0120", "a")], "doc_id bigint, text string, items string")
    out = redact_documents(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"] is None, len(r["items"])) for r in out) == [(1, False, 1), (1, False, 1), (2, True, 0), (3, False, 0)]
    assert redact_documents(df.limit(0), "doc_id", "text").count() == 0
