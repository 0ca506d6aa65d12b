"""Devanagari to Latin letters, word glossaries, and sentence chunks: what no built-in expresses."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql.functions import PandasUDFType, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def _letter(c: str) -> tuple[str, str]:
    """(kind, Latin) of a sign of the block, by its Unicode name: letters carry their sound there."""
    name = unicodedata.name(c, "")
    if name.startswith("DEVANAGARI LETTER "):
        sound = name.rsplit(" ", 1)[1].lower()
        whole = len(sound) == 1 or sound[0] in "aeiou" or name.endswith(("VOCALIC R", "VOCALIC L"))
        return ("vowel", sound) if whole else ("consonant", sound[:-1])
    if name.startswith("DEVANAGARI VOWEL SIGN "):
        return "sign", name.rsplit(" ", 1)[1].lower()
    if name.startswith("DEVANAGARI DIGIT "):
        return "other", str(unicodedata.digit(c))
    return {"DEVANAGARI SIGN VIRAMA": ("virama", ""), "DEVANAGARI SIGN ANUSVARA": ("other", "n"), "DEVANAGARI SIGN CANDRABINDU": ("other", "n"), "DEVANAGARI SIGN VISARGA": ("other", "h"), "DEVANAGARI SIGN NUKTA": ("other", ""), "DEVANAGARI DANDA": ("other", ".")}.get(name, ("other", c))


def latin(text: str) -> str:
    """A consonant sounds with an a unless a vowel sign or a virama follows, or the word ends."""
    out, open_ = [], False
    for c in text:
        kind, sound = _letter(c) if "ऀ" <= c <= "ॿ" else ("plain", c)
        if open_ and kind in ("consonant", "vowel", "other") and not (kind == "other" and not sound):
            out.append("a")
        if kind != "virama":
            out.append(sound)
        open_ = kind == "consonant" or (open_ and kind == "other" and not sound)
    return "".join(out)


@pandas_udf(StringType())
def transliterate(x):
    return x.map(lambda t: None if t is None else latin(t))


TRANSLATION = StructType([StructField("text", StringType()), StructField("coverage", DoubleType()), StructField("status", StringType()), StructField("unknown", ArrayType(StringType()))])


def glossed(glossary: dict[str, str]) -> Callable:
    """A function of a column: word by word by a glossary, else letter by letter; how much the glossary knew, and what not."""

    def one(text):
        if text is None:
            return {"text": None, "coverage": None, "status": None, "unknown": None}
        words = re.findall(r"\S+", text)
        keys = [re.sub(r"[^\wऀ-ॿ]+", "", w).lower() for w in words]
        known = [k in glossary for k in keys]
        share = int(sum(known) / len(words) * 1e4 + 0.5) / 1e4 if words else 1.0
        status = "ok" if share >= 0.8 else "partial" if share > 0 else "pending"
        return {"text": " ".join(glossary[k] if k in glossary else latin(w) for k, w in zip(keys, words, strict=True)), "coverage": share, "status": status, "unknown": sorted({k for k, hit in zip(keys, known, strict=True) if not hit})}

    def series(x):
        import pandas as pd

        return pd.DataFrame([one(t) for t in x], columns=["text", "coverage", "status", "unknown"])

    return pandas_udf(series, TRANSLATION, PandasUDFType.SCALAR)


def sentence_chunks(text: str, most: int = 1200, overlap: int = 150) -> list[str]:
    """Sentences packed into chunks of at most so many letters, each beginning with the tail of the one before it."""
    out, now = [], ""
    for sentence in re.split(r"(?<=[.!?।])\s+", text.strip()):
        if now and len(now) + 1 + len(sentence) > most:
            out.append(now)
            now = now[-overlap:].lstrip() if overlap else ""
        now = f"{now} {sentence}".strip() if now else sentence
        while len(now) > most:
            out.append(now[:most])
            now = now[most - overlap :]
    return [*out, now] if now else out


@pandas_udf(ArrayType(StringType()))
def chunks(x):
    return x.map(lambda t: [] if t is None else sentence_chunks(t))
