"""Formulas whose brackets nest to any depth: matched where a formula is read."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shipping import ship

#: What may open, close or begin a binomial: commands and escaped marks as wholes, and single brackets.
MARK = re.compile(r"(?s)\\[a-zA-Z]+|\\.|[{}]")
#: What stands before a group's bracket, and before an exponent or an index.
OPENS, SCRIPT = re.compile(r"[ \t\n\r\f\v]*\{"), re.compile(r"[ \t\n\r\f\v]*[\^_]")


def binomials(latex: str, command: str = r"\binom") -> list[tuple[int, int, bool]]:
    """(start, stop, scripted): the commands with two whole groups behind them, those inside another left out, by the offsets of their
    beginning and of their end. scripted: an exponent or an index follows. Blanks may stand between; brackets are matched to any depth."""
    opened, partner, commands = [], {}, []
    for m in MARK.finditer(latex):
        token = m.group()
        if token == "{":
            opened.append(m.start())
        elif token == "}":
            if opened:
                partner[opened.pop()] = m.end()
        elif token == command:
            commands.append((m.start(), m.end()))
    found, behind = [], 0
    for start, stop in commands:
        if start < behind:
            continue
        for _ in range(2):
            m = OPENS.match(latex, stop)
            stop = partner.get(m.end() - 1) if m else None
            if stop is None:
                break
        else:
            found.append((start, stop, SCRIPT.match(latex, stop) is not None))
            behind = stop
    return found


def grouped(latex: str) -> str:
    """A formula with each binomial that carries an exponent or an index put into a group of its own."""
    pieces, at = [], 0
    for start, stop, scripted in binomials(latex):
        if scripted:
            pieces += [latex[at:start], "{", latex[start:stop], "}"]
            at = stop
    return "".join([*pieces, latex[at:]])


def grouped_binomials(formulas: DataFrame, key: str = "id", text_col: str = "latex") -> DataFrame:
    """(key, latex) with each binomial that carries an exponent or an index put into a group of its own.

    A formula is matched where it is read: its tokens are neither rows nor shuffled, and texts without a binomial don't go to Python.
    """
    ship(formulas.sparkSession)

    @F.pandas_udf("string")
    def in_groups(latex: pd.Series) -> pd.Series:
        return latex.map(grouped)

    asks = F.col(text_col).contains(r"\binom")
    return formulas.select(key, F.when(asks, in_groups(F.when(asks, F.col(text_col)).otherwise(""))).otherwise(F.col(text_col)).alias("latex"))
