"""Substitution matrices for alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The twenty standard residues, in the order of the table.
STANDARD = "ARNDCQEGHILKMFPSTWYV"
#: The scores of the engine to be matched, 24 x 24, rows and columns in the order of STANDARD and then B, Z, X
#: and a last residue. It is the public BLOSUM62 but for F against A (-1; public -2), B against F (-1; public -3) and
#: the last row and column (public: the stop sign, -4 and 1).
SCORES = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -2
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -2
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -1
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -1
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -3
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -1
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -1
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -2
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -1
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -1
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -1
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -1
-1 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -1
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -1
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -1
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -2
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -2 -3 -2 -1 -2
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -2  4 -3 -2 -1 -1
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -1 -2  0 -1 -4 -3 -3  4  1 -1 -1
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -1
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -1
-2 -2 -1 -1 -3 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1  4
"""

#: The score of a residue that a matrix lacks.
MISSING = -4


class SubstitutionMatrix:
    """Scores of residue pairs; the query's residue names the row."""

    def __init__(self, letters: str, table: np.ndarray):
        self.letters, self.table = letters, np.asarray(table, np.int32)
        #: 27 x 27 over A-Z and 'other', for aligners
        self.dense = np.full((27, 27), MISSING, np.int32)
        for i, a in enumerate(letters):
            for j, b in enumerate(letters):
                self.dense[ord(a) - 65, ord(b) - 65] = self.table[i, j]

    def score(self, a: str, b: str) -> int:
        i, j = self.letters.find(a), self.letters.find(b)
        return int(self.table[i, j]) if a and b and i >= 0 and j >= 0 else MISSING

    def frame(self, spark: SparkSession) -> DataFrame:
        """(a, b, score): the matrix as a table to join on."""
        rows = [(a, b, int(self.table[i, j])) for i, a in enumerate(self.letters) for j, b in enumerate(self.letters)]
        return spark.createDataFrame(rows, "a string, b string, score int")

    @classmethod
    def parse(cls, text: str) -> SubstitutionMatrix:
        """From the usual text form: a line of letters, then a letter and its scores in each line; '#' comments."""
        lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
        columns = lines[0]
        kept = [c for c in columns if c.isalpha()]
        rows = {x[0]: dict(zip(columns, map(int, x[1:]), strict=True)) for x in lines[1:]}
        return cls("".join(kept), np.array([[rows[a][b] for b in kept] for a in kept]))


def _scores() -> np.ndarray:
    return np.array([[int(x) for x in line.split()] for line in SCORES.strip().split("\n")], np.int32)


def standard() -> SubstitutionMatrix:
    """BLOSUM62 with B, Z and X, symmetric."""
    table = _scores()[:23, :23]
    letters = STANDARD + "BZX"
    table[letters.index("F"), letters.index("A")] = -2
    table[letters.index("B"), letters.index("F")] = -3
    return SubstitutionMatrix(letters, table)


def parity() -> SubstitutionMatrix:
    """The fixed table under the letters X, U, O and J for its last four rows: what the engine to be matched computes
    with. B and Z are missing from it."""
    return SubstitutionMatrix(STANDARD + "XUOJ", _scores())
