"""Rows scored by a function of the caller's, with retries that hand the error back and failures set aside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, _parse_datatype_string

ERROR_CHARS = 300
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def _tried(scorer: Scorer, rows: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """(scored rows by their index, errors of the other rows); a call that fails on several rows is made again for each alone."""
    try:
        out = scorer(rows)
    except Exception as failure:  # noqa: BLE001 - whatever a scorer raises is a failure of its rows
        if len(rows) > 1:
            parts = [_tried(scorer, rows.iloc[k : k + 1]) for k in range(len(rows))]
            good = [p for p, _ in parts if len(p)]
            return pd.concat(good) if good else rows.iloc[:0], {i: e for _, errors in parts for i, e in errors.items()}
        return rows.iloc[:0], {rows.index[0]: f"{type(failure).__name__}: {failure}"[:ERROR_CHARS]}
    if len(rows) == len(out) == 1 and out.index[0] == rows.index[0]:  # a row alone needs no frames to be told apart
        told = out["error"].iat[0] if "error" in out.columns else None
        return (out, {}) if pd.isna(told) else (rows.iloc[:0], {rows.index[0]: str(told)[:ERROR_CHARS]})
    out = out[out.index.isin(rows.index) & ~out.index.duplicated()]
    told = out["error"].dropna() if "error" in out else pd.Series(dtype=object)
    errors = {i: str(e)[:ERROR_CHARS] for i, e in told.items()}
    errors |= dict.fromkeys(rows.index.difference(out.index), "the scorer returned no row")
    return out.drop(index=list(told.index)), errors


def score_rows(df: DataFrame, scorer: Scorer, result: str, attempts: int = 4, rows_at_once: int = 200) -> DataFrame:
    """df with the columns of `result` (a schema), attempts and error; a row a row of df, whatever the scorer does.

    scorer(pdf) -> pdf gets up to rows_at_once rows of df and a column last_error (null at first) and returns the result columns for
    those it has scored, with the index it was given.  A row that it leaves out, gives a text in a column `error`, or raises on comes
    again with that error, up to `attempts` times in all; a call that raises on several rows is made for each alone, so a bad row
    takes no other with it.  What still fails has null results and its last error: `sources.files.append_results` writes
    these to a table of their own.  Nulls come to the scorer as they are; an empty table stays empty.
    """
    wanted = _parse_datatype_string(result)
    names = [f.name for f in wanted.fields]
    schema = StructType([*df.schema.fields, *(StructField(f.name, f.dataType) for f in wanted.fields), StructField("attempts", IntegerType()), StructField("error", StringType())])

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        done, waiting, errors = [], rows.assign(last_error=None), {}
        for attempt in range(1, attempts + 1):
            good, errors = _tried(scorer, waiting)
            if len(good):
                done.append(good.reindex(columns=names).assign(attempts=attempt, error=None))
            waiting = waiting.loc[list(errors)].assign(last_error=pd.Series(errors, dtype=object)) if errors else waiting.iloc[:0]
            if not len(waiting):
                break
        if len(waiting):
            done.append(pd.DataFrame({**dict.fromkeys(names), "attempts": attempts, "error": [errors[i] for i in waiting.index]}, index=waiting.index, dtype=object))
        results = pd.concat([d.astype(object) for d in done]).reindex(rows.index)
        return pd.concat([rows, results.where(results.notna(), None)], axis=1)[schema.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            for start in range(0, len(batch), rows_at_once):
                yield settle(batch.iloc[start : start + rows_at_once])

    return df.mapInPandas(run, schema)
