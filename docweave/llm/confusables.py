"""Problem 5: one form for texts that print alike.

``skeleton`` follows the confusables-skeleton recipe: decompose, replace every character by the prototype of its look-alike class,
decompose again.  Two texts print alike exactly when their skeletons are equal.

Defined results: a null text has a null skeleton and is in no group; a text of nothing printable has the skeleton ``""`` and groups
with other such texts; case, marks, punctuation and the number of blanks are kept; very long texts are treated whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.runtime import settled

#: Records of a class of look-alikes that meet the class in one slot.
ROWS_A_SLOT = 2000

# Letters of other scripts (and Latin variants) drawn like a Latin letter, as look-alike=prototype pairs.
LOOKALIKES = (
    # Cyrillic capitals
    "А=A В=B Е=E Ѕ=S І=I Ј=J К=K М=M Н=H О=O Р=P С=C Т=T Ү=Y Х=X Ԁ=d Ԛ=Q Ԝ=W Ѵ=V Ғ=F Ꮯ=C "
    # Cyrillic small letters
    "а=a е=e ѕ=s і=i ј=j о=o р=p с=c у=y ү=y х=x һ=h ԁ=d ԛ=q ԝ=w ѵ=v ӏ=l ѡ=w "
    # Greek
    "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϲ=C Ϳ=J "
    "ο=o ν=v ι=i α=a ϲ=c ϳ=j ρ=p υ=u γ=y σ=o ϱ=p "
    # Armenian
    "ո=n օ=o հ=h ս=u զ=q ց=g յ=j Օ=O Տ=S Լ=L ք=f ա=w ե=t "
    # Latin variants; letters with a stroke stay, only their doubles move to them
    "Ð=Đ Ɖ=Đ ɑ=a ɡ=g ı=i ſ=f ʋ=v ᴏ=o ᴄ=c ᴠ=v ᴡ=w ᴢ=z ꜱ=s ȷ=j "
    # punctuation drawn alike
    "‐=- ‑=- ‒=- −=- ⁃=- ˗=- ʼ=’ ʹ=' ′=' ʻ=‘ ˈ=' ‚=, ‛=‘ ∶=: ։=: ꞉=: ⁄=/ ∕=/ ․=. ⁎=* ∗=* ‹=< ›=> ; =; "
)
# Characters that print nothing but aren't in Unicode's format category.
SILENT = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Compatibility forms that keep the letter and only change its width, breaking or typeface, or put several letters into one cell.
FOLDED_FORMS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """Code point -> what is drawn for it; only code points that change are held."""
    table: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs", "Lo") and cp not in (0x3164, 0xFFA0, 0x115F, 0x1160) and not 0xFB00 <= cp <= 0xFFEF:
            continue
        if kind in ("Cf", "Cc") and ch not in "\t\n\v\f\r\x85" or ch in SILENT or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            table[cp] = ""
        elif kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
            if ch != " ":
                table[cp] = " "
        elif (form := unicodedata.decomposition(ch)).startswith("<") and form.split(" ", 1)[0] in FOLDED_FORMS:
            if not (plain := unicodedata.normalize("NFKD", ch)).startswith(" "):
                table[cp] = plain
    for pair in LOOKALIKES.split(" "):
        if len(pair) == 3 and pair[1] == "=":
            table[ord(pair[0])] = pair[2]
    return table


def read_confusables(lines) -> dict[int, str]:
    """Look-alikes from lines of the public confusables format (``source ; prototype ; type # comment``, code points in hexadecimal); prototypes of several letters are kept."""
    table: dict[int, str] = {}
    for line in lines:
        fields = [x.strip() for x in line.lstrip("\ufeff").split("#", 1)[0].split(";")]
        if len(fields) > 1 and fields[0] and " " not in fields[0]:
            table[int(fields[0], 16)] = "".join(chr(int(x, 16)) for x in fields[1].split())
    return table


class Skeletons(dict):
    """Part of a text without blanks -> its printed form, remembered.  A blank begins anew whatever marks follow it, so a text's form is that of its parts."""

    def __init__(self, lookalikes: dict[int, str] | None = None):
        super().__init__()
        self.table = prototypes() if lookalikes is None else prototypes() | lookalikes

    def __missing__(self, part: str) -> str:
        if len(self) > 200_000:
            self.clear()
        form = part
        if not (part.isascii() and part.isprintable()):
            form = unicodedata.normalize("NFD", unicodedata.normalize("NFD", part).translate(self.table).translate(self.table))
        self[part] = form
        return form

    def of(self, text: str) -> str:
        return " ".join(map(self.__getitem__, text.split(" ")))


_DEFAULT: list[Skeletons] = []


def skeleton(text: str) -> str:
    """The printed form of one text, by the default table."""
    if not _DEFAULT:
        _DEFAULT.append(Skeletons())
    return _DEFAULT[0].of(text)


def skeleton_column(text: Column, lookalikes: dict[int, str] | None = None) -> Column:
    """``lookalikes`` (code point -> prototype, see ``read_confusables``) come on top of LOOKALIKES."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Skeletons(lookalikes)
        for texts in batches:
            yield pd.Series([None if t is None or t != t else known.of(t) for t in texts], index=texts.index, dtype=object)

    return run(text)


def _forms(df: DataFrame, key: str, text: str, lookalikes: dict[int, str] | None) -> DataFrame:
    """``id, form, class_id`` of each record and text: digests of the text and of its skeleton, which is computed once and written down."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    rows = rows.select("id", F.md5("__text").alias("form"), F.md5(skeleton_column(F.col("__text"), lookalikes)).alias("class_id"))
    return settled(rows.distinct())


def printed_classes(df: DataFrame, key: str, text: str, lookalikes: dict[int, str] | None = None) -> DataFrame:
    """One row per distinct (record, text): ``key, text_hash, class_id, n_forms``.

    ``class_id`` is a 128-bit digest of the skeleton; ``n_forms`` counts the different texts of the class.  Only digests are shuffled, and
    the number of forms is aggregated map-side first, so a class that holds a third of all rows costs one row per partition and form.
    """
    rows = _forms(df, key, text, lookalikes)
    forms = rows.groupBy("class_id", "form").agg(F.lit(1).alias("__n")).groupBy("class_id").agg(F.count("*").alias("n_forms"))
    return rows.join(forms, "class_id").select(F.col("id").alias(key), F.col("form").alias("text_hash"), "class_id", "n_forms")


def alike_pairs(df: DataFrame, key: str, text: str, lookalikes: dict[int, str] | None = None) -> DataFrame:
    """``id_a, id_b`` (smaller first) of records whose texts differ but print alike.

    Classes with a single form have no pair and are dropped before the join, so exact copies never meet each other.  The records of a large class are dealt
    over slots that each meet the whole class, so that no task makes more than ROWS_A_SLOT times the class's pairs of one record.
    """
    rows = _forms(df.where(F.col(key).isNotNull()), key, text, lookalikes)
    classes = rows.groupBy("class_id").agg(F.min("form").alias("lo"), F.max("form").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    slots = classes.select("class_id", F.ceil(F.col("n") / ROWS_A_SLOT).cast("int").alias("slots"))
    mixed = rows.join(slots, "class_id")
    a = mixed.select("class_id", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot"), F.col("id").alias("id_a"), F.col("form").alias("form_a"))
    b = mixed.select("class_id", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("id").alias("id_b"), F.col("form").alias("form_b"))
    return a.join(b, ["class_id", "slot"]).where("id_a < id_b and form_a <> form_b").select("id_a", "id_b").distinct()
