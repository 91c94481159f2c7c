"""Personal information in free text: found, and replaced by typed placeholders that stay linked.

A placeholder names the type and carries a pseudonym. Numbers are permuted within their own format by
a keyed Feistel network: a phone number keeps its country code and its separators, and the same number
written with or without them, at home or from abroad, in digits or in words, has the same new digits; an
identity number keeps valid dates and check characters. Other items get a keyed tag of 128 bits. So equal values have equal placeholders in all documents, and nobody without the key can
tell what they stood for.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import feistel
from cadenza.llm import piirules as R
from cadenza.session import cut_lineage

#: The key of tests and examples; give your own.
KEY = b"cadenza-example-key"


def _tag(kind: str, value: str, key: bytes) -> str:
    plain = " ".join(unicodedata.normalize("NFKC", value).casefold().split())
    return hashlib.blake2b(f"{kind}|{plain}".encode(), key=key, digest_size=16).hexdigest()


def _email_form(value: str) -> str:
    """One spelling for all ways to write an address."""
    v = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|艾特|\s*@\s*", "@", value.casefold())
    return re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", ".", v)


def _chinese_id(digits: str, key: bytes) -> str:
    try:
        day = feistel.permute_day(date(int(digits[6:10]), int(digits[10:12]), int(digits[12:14])), key)
    except ValueError:
        return feistel.permute_digits(digits[:17], key, "id")
    rest = feistel.permute_digits(digits[:6] + digits[14:17], key, "id")
    first = f"{rest[:6]}{day:%Y%m%d}{rest[6:]}"
    return first + R.china_check(first)


#: Country codes of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Digits as they are spoken.
_SPOKEN = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())} | {"oh": "0", "zwo": "2"} | {c: str(i) for i, c in enumerate("零一二三四五六七八九")} | {"〇": "0", "幺": "1"}


def written_digits(value: str) -> str:
    """A number that is spoken, in digits; "double" doubles the next."""
    words = re.findall(r"[a-zà-ÿ]+|[一-鿿〇]|\d+", value.casefold())
    out, twice = "", False
    for w in words:
        if w == "double":
            twice = True
        elif (d := _SPOKEN.get(w, w if w.isdigit() else "")) :
            out += d * (2 if twice else 1)
            twice = False
    return out


def phone_parts(value: str) -> tuple[int, int]:
    """(digits in front that say how a number is dialled, digits of the number itself at the end).

    In front stand the country code, with + or 00, a zero in brackets after it, and the 0 or 1 by which a call
    within a country begins: what is left is the same however a number was written.
    """
    digits = re.sub(r"\D", "", value)
    start = value.lstrip("( ")
    front = 0
    if start.startswith("+") or digits.startswith("00"):
        lead = 0 if start.startswith("+") else 2
        rest = digits[lead:]
        front = lead + next((n for n in (1, 2) if rest[:n] in _CODES), 3)
        if digits[front : front + 1] == "0" and re.search(r"\(0\)|[ .-]0", value):
            front += 1
    elif digits.startswith("0"):
        front = 1
    elif len(digits) == 11 and digits[0] == "1" and (digits[1] in "2" or re.match(r"\(?1\D", value)):
        front = 1
    return front, max(len(digits) - front, 0)


def _phone(value: str, key: bytes) -> str:
    if not re.search(r"\d{2}", value):
        value = written_digits(value)
    front, rest = phone_parts(value)
    return feistel.permute_in_place(value, key, "phone", front) if rest else _tag("phone", value, key)


def _french_id(digits: str, key: bytes) -> str:
    """Sex kept, year and month permuted among themselves, the rest too; a valid key stays valid."""
    year = feistel.permute(int(digits[1:3]), 100, key, "insee-year")
    month = feistel.permute(int(digits[3:5]) - 1, 12, key, "insee-month") + 1 if 1 <= int(digits[3:5]) <= 12 else int(digits[3:5])
    new = f"{digits[0]}{year:02d}{month:02d}" + feistel.permute_digits(digits[5:13], key, "insee")
    return new + (f"{97 - int(new) % 97:02d}" if len(digits) == 15 else "")


def _identity(v: str, key: bytes) -> str:
    compact = re.sub(r"[ .-]", "", v)
    digits = re.sub(r"\D", "", v)
    if re.fullmatch(r"\d{17}[\dXx]", compact):
        new = _chinese_id(compact, key)
    elif m := re.fullmatch(r"([XYZxyz]?)(\d{7,8})([A-Za-z])", compact):
        new = m[1] + feistel.permute_digits(m[2], key, "id")
        new += R.dni_letter(new)
    elif re.fullmatch(r"\d{11}", compact) and R.cpf_checks(compact[:9]) == compact[9:] and "-" in v:
        new = feistel.permute_digits(compact[:9], key, "cpf")
        new += R.cpf_checks(new)
    elif re.fullmatch(r"\d{11}", compact) and R.steuer_check(compact[:10]) == compact[10]:
        new = feistel.permute_digits(compact[:10], key, "steuer")
        new += R.steuer_check(new)
    elif re.fullmatch(r"[12]\d{12}(\d{2})?", compact) and (len(compact) == 13 or int(compact[13:]) == 97 - int(compact[:13]) % 97):
        new = _french_id(compact, key)
    else:
        return feistel.permute_in_place(v, key, "id") if digits else _tag("identity_number", v, key)
    # The marks between the characters stay where they were.
    chars = iter(new)
    return "".join(c if c in " .-" else next(chars) for c in v)


def pseudonym(kind: str, value: str, key: bytes = KEY) -> str:
    """What stands for ``value`` in its placeholder: the same for equal values, another for others."""
    v = R.normalized(value)
    if kind == "phone":
        return _phone(v, key)
    if kind == "identity_number":
        return _identity(v, key)
    return _tag(kind, _email_form(v) if kind == "email" else v, key)


def replace(text: str, found: list[tuple[str, int, int]], key: bytes = KEY) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(text with placeholders, items as (type, start, end, placeholder)), positions in code points."""
    out: list[str] = []
    items = []
    done = 0
    for kind, start, end in sorted(found, key=lambda x: x[1]):
        placeholder = f"[{kind.upper()} {pseudonym(kind, text[start:end], key)}]"
        items.append((kind, start, end, placeholder))
        out += [text[done:start], placeholder]
        done = end
    out.append(text[done:])
    return "".join(out), items


def redact(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int, str]]]:
    """``replace`` of all that can be found in a text by itself."""
    return replace(text, R.find(text), key)


_FOUND = pa.struct([("pii_type", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_NAMES = pa.struct([("name_key", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_FOUND_SPARK = "struct<pii_type:string,char_start:int,char_end:int>"
_ITEMS = pa.list_(pa.struct([("pii_type", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("placeholder", pa.string())]))
#: Texts that must call somebody by a name before it is one wherever it stands.
CALLED_IN = 2


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    flat = [x for row in rows for x in row]
    offsets = pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array([x[i] for x in flat], kind.field(i).type) for i in range(kind.num_fields)], fields=[kind.field(i) for i in range(kind.num_fields)]))


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of each text, keys of the persons it names, and what could be a name."""
    for batch in batches:
        items, keys, maybe = [], [], []
        for t in batch.column(0).to_pylist():
            found = R.find(t)
            plain = R.normalized(t)
            items.append(found)
            keys.append(sorted({k for kind, a, b in found if kind == "person_name" and (k := R.name_key(plain[a:b]))}))
            maybe.append(R.may_be_names(t, found))
        yield pa.RecordBatch.from_arrays([batch.column(1), _structs(items, _FOUND), pa.array(keys, pa.list_(pa.string())), _structs(maybe, _NAMES)], names=["h", "items", "keys", "maybe"])


def find_items(documents: DataFrame, text: str) -> DataFrame:
    """(h, items): the items of every distinct text that has any, by the hash of the text.

    A text's own marks and contexts tell most items. A run of words that could be a name, and has no context,
    is one if CALLED_IN other texts call persons by its given name (in Chinese by its family name).
    """
    texts = documents.filter(F.length(text) > 0).select(F.col(text).alias("text"), text_hash(text).alias("h"))
    looked = cut_lineage(texts.mapInArrow(_look, f"h string, items array<{_FOUND_SPARK}>, keys array<string>, maybe array<struct<name_key:string,char_start:int,char_end:int>>"))
    called = looked.select("h", F.explode("keys").alias("name_key")).groupBy("name_key").agg(F.approx_count_distinct("h").alias("n")).filter(F.col("n") >= CALLED_IN).select("name_key")
    maybe = looked.select("h", F.explode("maybe").alias("m")).select("h", "m.*")
    anyway = F.col("name_key").startswith("z:") & ((F.length("name_key") > 3) | F.substring("name_key", 3, 1).isin(*R.FREQUENT_FAMILY))
    names = maybe.filter(anyway).unionByName(maybe.filter(~anyway).join(called, "name_key", "left_semi"))
    names = names.select("h", F.struct(F.lit("person_name").alias("pii_type"), "char_start", "char_end").alias("i"))
    every = looked.select("h", F.explode("items").alias("i")).unionByName(names).distinct()
    return every.groupBy("h").agg(F.array_sort(F.collect_list("i")).alias("items"))  # as many as a text has


def text_hash(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def redact_documents(documents: DataFrame, ident: str, text: str, key: bytes = KEY) -> DataFrame:
    """(<ident>, text, items): the text with placeholders, and what was replaced.

    ``items`` is an array of (pii_type, char_start, char_end, placeholder); positions are code points of
    the text as it came. Types: email, phone, identity_number, street_address, person_name.

    Defined results: NULL stays NULL and has no items; an empty text and one without items stay as they
    are; texts are read whole, however long; a repeated row gives a row each time; an empty table gives
    none; other columns are ignored.
    """
    ident_type = documents.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new, replaced = replace(t, _apart([(i["pii_type"], i["char_start"], i["char_end"]) for i in found]), key) if found else (t, [])
                texts.append(new)
                items.append(replaced)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), _structs(items, _ITEMS.value_type)], names=[ident, "text", "items"])

    rows = documents.select(F.col(ident), F.col(text).alias("__text"))
    found = find_items(rows, "__text")
    rows = rows.withColumn("h", text_hash("__text")).join(found, "h", "left").select(ident, "__text", "items")
    return rows.mapInArrow(run, f"`{ident}` {ident_type}, text string, items array<struct<pii_type:string,char_start:int,char_end:int,placeholder:string>>")


def _apart(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without items that overlap one before them."""
    out: list[tuple[str, int, int]] = []
    for item in sorted(found, key=lambda x: (x[1], -x[2])):
        if not out or item[1] >= out[-1][2]:
            out.append(item)
    return out
