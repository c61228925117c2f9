"""Fill-in-middle: texts cut at two line ends and laid out for infilling."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.llm.boundaries import BoundarySet

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50

_SQL_TYPE = "n long, form string, prefix_chars long, middle_chars long, output string"
_LINE_END = re.compile("\n")
_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def line_boundaries(text: str) -> BoundarySet:
    """0 and the end of every line, in code points; a line takes its line feed along."""
    ends = [m.end() for m in _LINE_END.finditer(text)]
    if text and not text.endswith("\n"):
        ends.append(len(text))
    return BoundarySet([0, *ends])


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the id and the seed only."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def rearrange(text: str, doc_id, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """``(lines, form, prefix_chars, middle_chars, output)`` of one text."""
    lines = line_boundaries(text)
    n = len(lines) - 1
    first, second, share, order = draws(doc_id, seed)
    if not text or share % 100 >= fim_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = lines.select(low), lines.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with struct ``__fim`` (n, form, prefix_chars, middle_chars, output) added.

    The text's ``n`` lines are cut at two line ends drawn from a hash of seed
    and id, so the result does not depend on the partitioning and rows that
    share an id share the draws. Empty texts, texts that hold a mark and
    ``100 - fim_percent`` of the rest keep form ``plain``; of the others
    ``spm_percent`` put the suffix first. Null texts count as empty, a null id
    as an empty one. Whole texts are cut, however long; all columns of
    ``docs`` are kept, whatever their names, in an empty table as well.
    """

    @F.arrow_udf(_SQL_TYPE)
    def transform(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [rearrange(t or "", i, seed, fim_percent, spm_percent) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        columns = list(zip(*rows)) or [()] * len(_TYPE)
        return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _TYPE)], fields=list(_TYPE))

    return docs.withColumn("__fim", transform(F.col(id_col).cast("string"), F.col(text_col)))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    Parts hold no marks and a mark begins with its only ``<``, so the first
    place of a mark after the leading one is where it was put.
    """
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    third = F.locate(MIDDLE, output)
    one, two = output.substr(F.lit(4), second - 4), output.substr(second + 3, third - second - 3)
    three = output.substr(third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
