"""Residue letters, their codes, and Spark expressions that clean and encode sequences."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with scores, in code order. J, O and U, and any other symbol, are the dummy.
LETTERS = "ABCDEFGHIKLMNPQRSTVWXYZ"
DUMMY = len(LETTERS)
PADDING = DUMMY + 1
#: Code points of a sequence that are searched for rejected symbols at once.
CHUNK = 65_536
#: The dummy as a symbol.
DUMMY_SYMBOL = "["
#: Encoded residues are stored as bytes; a byte of 0 would end a translation table, so they start at 1.
FIRST_BYTE = 1

_CODES = np.full(256, DUMMY, np.uint8)
for _code, _letter in enumerate(LETTERS):
    _CODES[ord(_letter)] = _CODES[ord(_letter.lower())] = _code


def encode(sequence: str) -> np.ndarray:
    """Codes 0 to 23 of a sequence, either case; a code point that is no letter of the alphabet is one dummy."""
    return _CODES[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]


def decoded(residues: bytes) -> np.ndarray:
    """Codes of stored residues."""
    return np.frombuffer(residues, np.uint8) - np.uint8(FIRST_BYTE)


def upper(sequence: Column) -> Column:
    """a to z in upper case; no other letter changes, so none becomes a residue or changes the length."""
    return F.translate(sequence, string.ascii_lowercase, string.ascii_uppercase)


def clean(sequence: Column, strict: bool = False) -> Column:
    """Upper-case residues without white space; null stays null.

    Symbols that are no letters become the dummy when scored; with `strict` they raise an error.
    """
    residues = upper(F.regexp_replace(sequence, r"\s", ""))
    if not strict:
        return residues
    wrong = F.raise_error(F.concat(F.lit("not a residue sequence: "), F.substring(residues, 1, 60)))
    return F.when(residues.rlike("[^A-Z]"), wrong).otherwise(residues)


def encoded(residues: Column) -> Column:
    """Residues, in either case, as stored bytes, without leaving the JVM; null has none."""
    symbols = F.regexp_replace(upper(F.coalesce(residues, F.lit(""))), f"[^{LETTERS}]", DUMMY_SYMBOL)
    return F.translate(symbols, LETTERS + DUMMY_SYMBOL, "".join(chr(FIRST_BYTE + k) for k in range(DUMMY + 1))).cast("binary")


def rejected(residues: Column) -> Column:
    """Symbols of cleaned residues that are no letters from A to Z, as an array of `offset` (from 0) and `symbol`.

    Null and sequences of letters have none. A sequence is searched in chunks, so that memory follows a
    chunk and what is found, not the sequence.
    """

    def of_chunk(start: Column) -> Column:
        symbols = F.split(F.substring(residues, start + F.lit(1), F.lit(CHUNK)), "")
        return F.filter(F.transform(symbols, lambda c, i: F.struct((start + i).cast("long").alias("offset"), c.alias("symbol"))), lambda x: x["symbol"].rlike("[^A-Z]"))

    starts = F.sequence(F.lit(0), F.length(residues) - F.lit(1), F.lit(CHUNK))
    none = F.array().cast("array<struct<offset:bigint,symbol:string>>")
    return F.when(residues.rlike("[^A-Z]"), F.flatten(F.transform(starts, of_chunk))).otherwise(none)


def letters_of(text: Column) -> Column:
    """The ASCII letters of a text as residues (null: none)."""
    return upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def codes(residues: Column) -> Column:
    """Array of residue codes, without leaving the JVM."""
    split = F.filter(F.split(residues, ""), lambda c: c != "")
    return F.transform(split, lambda c: F.when(F.instr(F.lit(LETTERS), c) > 0, F.instr(F.lit(LETTERS), c) - 1).otherwise(F.lit(DUMMY)))
