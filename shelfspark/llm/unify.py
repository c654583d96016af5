"""Visually identical text with different characters, brought to one form.

Compatibility normalisation with composed accents, white space and hyphens mapped to the ASCII
ones, default-ignorable characters removed, and letters that only look like another script's put
into the script of their word or code. Work is done once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of Cyrillic and Greek that look like a Latin one (fixed values).
CYRILLIC_LIKE = dict(zip("АВЕКМНОРСТУХаеорсухІіЈјЅѕԚԛԜԝһԁӏӀ", "ABEKMHOPCTYXaeopcyxIiJjSsQqWwhdlI"))
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυ", "ABEZHIKMNOPTYXovaipu"))
#: Letters of scripts that no text here is written in, by the Latin ones they look like (fixed values).
OTHER_LIKE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴՕօսհոⲘⲚⲞⲢⲤ", "DRTAJEWMHGZRWVSLCPKBOouhnMNOPC"))
#: The Russian look-alike of a Latin letter.
TO_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyx", "АВЕКМНОРСТУХаеорсух"))
#: Compatibility characters that are proper signs of their own.
KEPT = "№²³°™®©…½¼¾ªº"
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_HYPHENS = regex.compile(r"[‐‑‒–−﹘﹣－]")
_BLANK = regex.compile(r"[^\S\n]")
_RUN = regex.compile(r"\p{L}\p{M}*(?:\p{L}\p{M}*)*")
_TOKEN = regex.compile(r"\S+")
_CODE = regex.compile(r"(?:\D*\d){5}")
_COMPAT = regex.compile(f"[^{regex.escape(KEPT)}]+")


def _script(run: str, code: bool) -> str:
    """Script of a word or of a code's letters: L, C, or nothing to decide.

    The letters that look like no other script's decide; if they disagree or are missing, the
    majority does. A code without any such letter is Latin.
    """
    latin = cyrillic = own_l = own_c = 0
    for ch in run:
        if ch in CYRILLIC_LIKE:
            cyrillic += 1
        elif "Ѐ" <= ch <= "ӿ":
            cyrillic += 1
            own_c += 1
        elif ch in TO_CYRILLIC:
            latin += 1
        elif ch in GREEK_LIKE:
            latin += ch not in "ΑΒΕΗΚΜΟΡΤΥΧο"
        elif ch.isascii() or "LATIN" in unicodedata.name(ch, ""):
            latin += 1
            own_l += 1
    if own_c and not own_l:
        return "C"
    if own_l and not own_c:
        return "L"
    if code:
        return "C" if own_c > own_l else "L"
    return "C" if cyrillic > latin else "L" if latin > cyrillic else ""


def _run(run: str, code: bool) -> str:
    if run.isascii() and not code:
        return run
    script = _script(run, code)
    out = []
    for ch in run:
        if script == "C":
            ch = GREEK_LIKE.get(ch, ch)
            ch = TO_CYRILLIC.get(ch, ch)
        else:
            ch = GREEK_LIKE.get(ch, ch)
            if script == "L":
                ch = CYRILLIC_LIKE.get(ch, ch)
                ch = OTHER_LIKE.get(ch, ch)
        out.append(ch)
    return "".join(out)


def _word(token: str, code_field: bool) -> str:
    code = code_field or bool(_CODE.match(token))
    if token.isascii() and not (code and code_field):
        return token
    return _RUN.sub(lambda m: _run(m[0], code), token)


@lru_cache(maxsize=100_000)
def unify(text: str, code_field: bool = False) -> str:
    """The consistent form of a text; letter case and the number of blanks stay as they are."""
    if text.isascii() and not any(c in text for c in "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"):
        return text
    t = _IGNORABLE.sub("", text)
    t = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
    t = unicodedata.normalize("NFC", _IGNORABLE.sub("", t))
    t = _BLANK.sub(" ", _HYPHENS.sub("-", t))
    return _TOKEN.sub(lambda m: _word(m[0], code_field), t)


def comparable(text: str, code_field: bool = False) -> str:
    """The form to compare by: unified, fully case-folded, blanks collapsed."""
    return " ".join(unify(text, code_field).casefold().split())


def differs(text: str, code_field: bool = False) -> bool:
    """Whether a value isn't in its consistent form, letter case and plain blanks aside."""
    u = unify(text, code_field)
    return u != text and regex.sub(" +", " ", u.lower()).strip(" ") != regex.sub(" +", " ", text.lower()).strip(" ")


def unify_fields(rows: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """key, field_name, value, unified, compared, changed for every non-null value of ``fields``
    (column name to: is it a code).

    Null values give no row, empty ones are unchanged; texts are read whole; every row counts, so
    repeated rows repeat; other columns are ignored.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(names, 1):
                column = batch.column(i)
                keep = column.is_valid()
                keys, values = batch.column(0).filter(keep), column.filter(keep)
                coded = values.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                forms = [unify(v, fields[name]) for v in distinct]
                parts = [pa.array(forms, pa.string()), pa.array([comparable(v, fields[name]) for v in distinct], pa.string()), pa.array([differs(v, fields[name]) for v in distinct], pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([name] * len(keys), pa.string()), values, *[p.take(coded.indices) for p in parts]],
                    ["k", "field_name", "value", "unified", "compared", "changed"],
                )

    out = rows.select(F.col(key).alias("k"), *names).mapInArrow(run, f"k {kind}, field_name string, value string, unified string, compared string, changed boolean")
    return out.withColumnRenamed("k", key)
