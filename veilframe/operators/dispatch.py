"""From an action and its parameters to the masked value, or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import amount, identity
from veilframe.operators.alias import aliases
from veilframe.operators.rules import ACTIONS

PARAMS = "struct<unit:string,decimal_places:bigint,percentage:double,prefix:string,keep_first:bigint,keep_prefix:bigint,keep_suffix:bigint,char:string>"
#: What larger numbers count as: a double has no more places, no text more characters.
PLACES, KEPT = 320, 1_000_000_000


def typed(params: Column) -> Column:
    """The known parameters of a JSON text; numbers that are missing, negative, fractions or JSON strings: the default."""
    p = F.from_json(F.coalesce(params, F.lit("{}")), PARAMS)
    whole = lambda x, default, top: F.coalesce(F.when(x >= 0, F.least(x, F.lit(top))), F.lit(default)).cast("int")
    text = lambda x, default: F.coalesce(x, F.lit(default))
    return F.struct(
        text(p["unit"], "million").alias("unit"), whole(p["decimal_places"], 2, PLACES).alias("decimal_places"), F.coalesce(p["percentage"], F.lit(5.0)).alias("percentage"),
        text(p["prefix"], "公司").alias("prefix"), whole(p["keep_first"], 1, KEPT).alias("keep_first"), whole(p["keep_prefix"], 3, KEPT).alias("keep_prefix"), whole(p["keep_suffix"], 4, KEPT).alias("keep_suffix"), text(p["char"], "*").alias("char"),
    )


def masked(value: Column, action: Column, params: Column, alias: Column | None = None) -> Column:
    """struct<value, error>: one of both is null. alias: the value's alias, where that action may occur."""
    alias = alias if alias is not None else F.lit(None).cast("string")

    def of(r: Column) -> Column:
        v, p, action = r["v"], r["p"], r["action"]
        done = {
            "precision": lambda: amount.precision(v, p["unit"], p["decimal_places"]), "perturb": lambda: amount.perturb(v, p["percentage"]), "mask": lambda: amount.mask(v),
            "mask_name": lambda: identity.mask_name(v, p["keep_first"]), "mask_account": lambda: identity.mask_account(v, p["keep_prefix"], p["keep_suffix"], p["char"]), "alias": lambda: r["alias"],
        }
        out = F.lit(None).cast("string")
        for k, make in done.items():
            out = F.when(action == k, make()).otherwise(out)
        return F.struct(out.alias("out"), r.alias("r"))

    def explained(x: Column) -> Column:
        r = x["r"]
        v, p, action = r["v"], r["p"], r["action"]
        error = (
            F.when(action.isin("differential_shift", "proportional_scale"), F.concat(action, F.lit(" works on all values of a column at once")))
            .when(~action.isin(*ACTIONS) | action.isNull(), F.concat(F.lit("unknown action: "), F.coalesce(action, F.lit("null"))))
            .when((action == "precision") & ~p["unit"].isin(*amount.TARGETS), F.concat(F.lit("unknown unit: "), p["unit"]))
            .when((action == "perturb") & ~p["percentage"].between(0, 100), F.lit("the percentage isn't from 0 to 100"))
            .otherwise(F.concat(F.lit("not an amount: "), v))
        )
        return F.struct(x["out"].alias("value"), F.when(x["out"].isNull(), error).alias("error"))

    row = F.struct(value.alias("v"), typed(params).alias("p"), action.alias("action"), alias.alias("alias"))
    return amount.let(amount.let(row, of), explained)


def redact(df: DataFrame, value: str = "value", action: str = "action", params: str = "params", ord: str = "ord", group: str | None = None) -> DataFrame:
    """df with redacted and error; aliases are numbered in the order of ord over all rows (of a group) that ask for one."""
    label = typed(F.col(params))["prefix"]
    own = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    asked = df.filter(F.col(action) == "alias").select(F.col(value).alias("v"), label.alias("p"), F.col(ord).alias("o"), own.alias("g"))
    names = aliases(asked, "v", "o", "p", group="g").select(F.col("group").alias("_g"), F.col("value").alias("_v"), F.col("alias").alias("_a"))
    key = F.when(F.col(action) == "alias", F.col(value))
    joined = df.withColumn("_key", key).join(names, (F.col("_key") == F.col("_v")) & (own == F.col("_g")), "left")
    result = masked(F.col(value), F.col(action), F.col(params), F.coalesce("_a", F.when(F.length(value) == 0, F.col(value))))
    return joined.withColumn("_r", result).withColumn("redacted", F.col("_r.value")).withColumn("error", F.col("_r.error")).drop("_r", "_key", "_v", "_a", "_g")


def numeric_write_back(action: Column, redacted: Column) -> Column:
    """What a cell gets: amounts as plain numbers where they are, all else as it is."""
    return F.when(action.isin("precision", "perturb", "mask"), amount.to_numeric_text(redacted)).otherwise(redacted)
