"""The functions by name, for SQL text over views that hold their results as columns.

Each call becomes a column made from the DataFrame functions, so Catalyst sees built-ins only. They can't be called
inside SQL text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from veilframe.functions import amount, identity

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "parse_amount": amount.parse_number, "round_amount": amount.precision, "perturb_amount": amount.perturb, "mask_amount": amount.mask, "amount_to_number": amount.to_numeric_text,
    "mask_name": identity.mask_name, "mask_account": identity.mask_account, "encode_mark": identity.encode_mark, "decode_mark": identity.decode_mark, "cell_letters": identity.column_letters,
}


def with_functions(df: DataFrame, **calls: tuple) -> DataFrame:
    """df with a column for each call: name=(function, column, further arguments…)."""
    return df.withColumns({name: FUNCTIONS[f](c, *more) for name, (f, c, *more) in calls.items()})


def view(df: DataFrame, name: str, **calls: tuple) -> None:
    """A temporary view of df with the calls' columns, for SQL text."""
    with_functions(df, **calls).createOrReplaceTempView(name)
