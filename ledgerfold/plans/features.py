"""Feature pipelines on the credit schema (application + six child tables).

Each child table is folded to one row per client (``SK_ID_CURR``) by a single
``groupBy`` with partial aggregation; subsets (Active/Closed, Approved/
Refused) are conditional aggregates in that same ``groupBy``; category
shares average a null-safe predicate instead of materialising one-hot
columns.  The assembled table is the application left-joined with the five
folded children -- each child is already one row per key, so every join is
1:≤1 and the children's exchanges are reused (no re-shuffle of raw rows).

Vocabularies are collected once per categorical column (bounded, sorted by
code point) and can be passed back in (``vocabularies=``) so that scoring
data gets exactly the training schema.  A column with more than
``max_categories`` values has no vocabulary (None) and no column per value: its
shares come as one map per client, its codes as one column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.names import clean_names
from ledgerfold.functions.nullsafe import clip_lower, not_equal_keep_null, safe_divide, sentinel_to_null
from ledgerfold.operators.aggregate import grouped_agg
from ledgerfold.operators.encode import (
    DEFAULT_MAX_CATEGORIES, EXPRESSIONS, category_share, category_share_long, factorize_many, one_hot,
    share_maps, small_vocabularies, string_columns, wide_shares)

KEY = "SK_ID_CURR"

# Fixed values of the reference pipelines: the day-offset sentinel, the
# binary-encoded application columns and the aggregation specifications.
DAYS_SENTINEL = 365243
BINARY_COLUMNS = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
PREV_SENTINEL_COLUMNS = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
                         "DAYS_LAST_DUE", "DAYS_TERMINATION"]

BUREAU_BALANCE_SPEC = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
PREVIOUS_SPEC = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
POS_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}
INSTALLMENTS_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
CREDIT_CARD_FUNCS = ["min", "max", "mean", "sum", "var"]

Spec = Mapping[str, Sequence[str]]


def restrict_spec(spec: Spec, columns: Sequence[str]) -> dict:
    """The part of a spec whose columns exist (for partial inputs)."""
    have = set(columns)
    return {c: list(f) for c, f in spec.items() if c in have}


def _vocabs(df: DataFrame, cols: Sequence[str], given: Mapping[str, Sequence] | None,
            max_categories: int) -> dict:
    """Given vocabularies (e.g. from a training manifest) or one job for the rest."""
    given = dict(given or {})
    out = {c: given[c] if given[c] is None else list(given[c]) for c in cols if c in given}
    out.update(small_vocabularies(df, [c for c in cols if c not in given], max_categories))
    return out


def _shares(df: DataFrame, cols: Sequence[str], vocabs: Mapping[str, Sequence],
            nan_as_category: bool, prefix: str, cond: Column | None = None) -> list[Column]:
    out = []
    for c in cols:
        out += category_share(c, vocabs[c], nan_as_category, prefix=prefix, condition=cond)
    return out


def _fold(df: DataFrame, key: str, spec: Spec, prefix: str, cats: Sequence[str],
          vocabs: Mapping[str, Sequence | None], nan_as_category: bool, more: Sequence[Column] = (),
          expressions: int = EXPRESSIONS, **subsets) -> DataFrame:
    """``grouped_agg`` by ``key`` with the category shares of ``cats``: as
    expressions of the same aggregate up to ``expressions`` values, by a pivot
    of counts beyond them, as a map without a vocabulary."""
    narrow = [c for c in cats if vocabs[c] is not None and len(vocabs[c]) <= expressions]
    others = [c for c in cats if c not in narrow]
    extra = _shares(df, narrow, vocabs, nan_as_category, prefix) + _shares(
        df, others, {c: [] for c in others}, nan_as_category, prefix)
    out = grouped_agg(df, key, spec, prefix=prefix, extra=extra + list(more), **subsets)
    for c in others:
        kid = (share_maps(df, key, c, f"{prefix}{c}_SHARES") if vocabs[c] is None
               else wide_shares(df, key, c, vocabs[c], prefix))
        out = out.join(kid, key, "left")
    return out


# -- P1 application -------------------------------------------------------------

def application_features(app: DataFrame, nan_as_category: bool = False,
                         vocabularies: Mapping[str, Sequence] | None = None,
                         order_key: str = KEY,
                         max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    """Filter unknown gender (nulls kept), binary-code three flags by first
    appearance, one-hot the other strings, null the day sentinel, add the
    five ratio features."""
    df = app.where(not_equal_keep_null("CODE_GENDER", "XNA")) if "CODE_GENDER" in app.columns else app
    df, _ = factorize_many(df, BINARY_COLUMNS, order_key, max_categories=max_categories)
    cats = string_columns(df)
    vocabs = _vocabs(df, cats, vocabularies, max_categories)
    df, _ = one_hot(df, cats, nan_as_category=nan_as_category, vocabularies=vocabs)
    cols = set(df.columns)
    if "DAYS_EMPLOYED" in cols:
        df = df.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED", DAYS_SENTINEL))
    ratios = {
        "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
        "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
        "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
    }
    new = [safe_divide(n, d).alias(name) for name, (n, d) in ratios.items()
           if n in cols and d in cols]
    return df.select("*", *new)


# -- P2 bureau + bureau balance ----------------------------------------------------

def bureau_features(bureau: DataFrame, bureau_balance: DataFrame,
                    nan_as_category: bool = True,
                    vocabularies: Mapping[str, Sequence] | None = None,
                    spec: Spec | None = None, balance_spec: Spec | None = None,
                    max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    """``BURO_*`` over all credits, ``ACTIVE_*``/``CLOSED_*`` over subsets.

    Monthly balances are folded per credit first (shuffle by
    ``SK_ID_BUREAU``), left-joined to the credits, then everything is
    folded per client (shuffle by ``SK_ID_CURR``).  Shares of balance
    statuses become per-credit means and then means of those means (sums of
    fractions: the last bits depend on the order of addition); statuses
    without a vocabulary become one map of such means per client.
    """
    spec = dict(spec or BUREAU_SPEC)
    bb_spec = dict(balance_spec or BUREAU_BALANCE_SPEC)
    bb_cats = string_columns(bureau_balance, exclude=["SK_ID_BUREAU"])
    bu_cats = string_columns(bureau, exclude=[KEY, "SK_ID_BUREAU"])
    vocabs = _vocabs(bureau_balance, bb_cats, vocabularies, max_categories)
    vocabs.update(_vocabs(bureau, bu_cats, vocabularies, max_categories))  # one job per table
    long = [c for c in bb_cats if vocabs[c] is None]
    bb_extra = _shares(bureau_balance, bb_cats, {c: vocabs[c] or [] for c in bb_cats}, nan_as_category, "")
    bb = grouped_agg(bureau_balance, "SK_ID_BUREAU", restrict_spec(bb_spec, bureau_balance.columns), extra=bb_extra)
    b = bureau.join(bb, "SK_ID_BUREAU", "left").drop("SK_ID_BUREAU")
    spec = restrict_spec(spec, b.columns)
    nested = [c for c in bb.columns if c.endswith("_MEAN") and c not in spec]
    subsets = {}
    active, closed = _dummy_cond(b, "CREDIT_ACTIVE", "Active"), _dummy_cond(b, "CREDIT_ACTIVE", "Closed")
    if active is not None:
        subsets = {"ACTIVE_": active, "CLOSED_": closed}
    out = _fold(b, KEY, spec, "BURO_", bu_cats, vocabs, nan_as_category,
                more=[F.avg(F.col(c)).alias(f"BURO_{c}_MEAN") for c in nested], subsets=subsets, subset_spec=spec)
    for c in long:
        out = out.join(_nested_share_maps(bureau, bureau_balance, c), KEY, "left")
    return out


def _nested_share_maps(bureau: DataFrame, bureau_balance: DataFrame, col: str) -> DataFrame:
    """Per client a map from balance status to the mean, over the client's
    credits with balances, of the status's share."""
    owners = bureau.select("SK_ID_BUREAU", KEY)
    shares = category_share_long(bureau_balance, ["SK_ID_BUREAU"], col).where(F.col("value").isNotNull())
    sums = shares.join(owners, "SK_ID_BUREAU").groupBy(KEY, "value").agg(F.sum("share").alias("_s"))
    credits_ = (bureau_balance.select("SK_ID_BUREAU").distinct().join(owners, "SK_ID_BUREAU")
                .groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")))
    entry = F.struct(F.col("value").alias("k"), (F.col("_s") / F.col("_n")).alias("v"))
    return (sums.join(credits_, KEY).groupBy(KEY)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"BURO_{col}_SHARES_MEAN")))


def _dummy_cond(df: DataFrame, col: str, value: str) -> Column | None:
    """The one-hot test ``<col>_<value> == 1`` as a predicate."""
    if col not in df.columns:
        return None
    return F.col(col).eqNullSafe(F.lit(value))


# -- P3 previous applications --------------------------------------------------------

def previous_features(prev: DataFrame, nan_as_category: bool = True,
                      vocabularies: Mapping[str, Sequence] | None = None,
                      spec: Spec | None = None,
                      max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    """``PREV_*`` over all, ``APPROVED_*``/``REFUSED_*`` over subsets."""
    cols = set(prev.columns)
    sent = [sentinel_to_null(c, DAYS_SENTINEL).alias(c) if c in PREV_SENTINEL_COLUMNS else F.col(c)
            for c in prev.columns]
    df = prev.select(*sent)
    if "AMT_APPLICATION" in cols and "AMT_CREDIT" in cols:
        df = df.withColumn("APP_CREDIT_PERC", safe_divide("AMT_APPLICATION", "AMT_CREDIT"))
    cats = string_columns(df, exclude=[KEY, "SK_ID_PREV"])
    vocabs = _vocabs(df, cats, vocabularies, max_categories)
    spec = restrict_spec(spec or PREVIOUS_SPEC, df.columns)
    subsets = {}
    if "NAME_CONTRACT_STATUS" in df.columns:
        subsets = {"APPROVED_": F.col("NAME_CONTRACT_STATUS").eqNullSafe(F.lit("Approved")),
                   "REFUSED_": F.col("NAME_CONTRACT_STATUS").eqNullSafe(F.lit("Refused"))}
    return _fold(df, KEY, spec, "PREV_", cats, vocabs, nan_as_category, subsets=subsets, subset_spec=spec)


# -- P4 POS / cash balances ------------------------------------------------------------

def pos_features(pos: DataFrame, nan_as_category: bool = True,
                 vocabularies: Mapping[str, Sequence] | None = None,
                 spec: Spec | None = None,
                 max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    cats = string_columns(pos, exclude=[KEY, "SK_ID_PREV"])
    vocabs = _vocabs(pos, cats, vocabularies, max_categories)
    spec = restrict_spec(spec or POS_SPEC, pos.columns)
    return _fold(pos, KEY, spec, "POS_", cats, vocabs, nan_as_category,
                 more=[F.count(F.lit(1)).alias("POS_COUNT")])


# -- P5 instalment payments -------------------------------------------------------------

def installment_columns(ins: DataFrame) -> DataFrame:
    """Payment share and difference, days past / before due clipped at 0
    (nulls -- missed payments -- stay null)."""
    return ins.select(
        "*",
        safe_divide("AMT_PAYMENT", "AMT_INSTALMENT").alias("PAYMENT_PERC"),
        (F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")).alias("PAYMENT_DIFF"),
        clip_lower(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"), 0).alias("DPD"),
        clip_lower(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT"), 0).alias("DBD"))


def installments_features(ins: DataFrame, nan_as_category: bool = True,
                          vocabularies: Mapping[str, Sequence] | None = None,
                          spec: Spec | None = None,
                          max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    df = installment_columns(ins)
    cats = string_columns(df, exclude=[KEY, "SK_ID_PREV"])
    vocabs = _vocabs(df, cats, vocabularies, max_categories)
    spec = restrict_spec(spec or INSTALLMENTS_SPEC, df.columns)
    return _fold(df, KEY, spec, "INSTAL_", cats, vocabs, nan_as_category,
                 more=[F.count(F.lit(1)).alias("INSTAL_COUNT")])


# -- P6 credit card balances --------------------------------------------------------------

def credit_card_features(cc: DataFrame, nan_as_category: bool = True,
                         vocabularies: Mapping[str, Sequence] | None = None,
                         funcs: Sequence[str] = CREDIT_CARD_FUNCS,
                         max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    """Five functions on *every* numeric column, category shares, count."""
    df = cc.drop("SK_ID_PREV")
    cats = string_columns(df, exclude=[KEY])
    vocabs = _vocabs(df, cats, vocabularies, max_categories)
    nums = [c for c in df.columns if c != KEY and c not in cats]
    spec = {c: list(funcs) for c in nums}
    return _fold(df, KEY, spec, "CC_", cats, vocabs, nan_as_category,
                 more=[F.count(F.lit(1)).alias("CC_COUNT")])


# -- P7 assembly ------------------------------------------------------------------------

def assemble(application: DataFrame, children: Sequence[DataFrame]) -> DataFrame:
    """Application left-joined with each folded child (≤ 1 row per key),
    names cleaned (collisions raise)."""
    from ledgerfold.operators.joins import left_join_child
    out = application
    for ch in children:
        out = left_join_child(out, ch, KEY)
    return clean_names(out)


def plan_vocabularies(frames: Sequence[DataFrame],
                      exclude: Sequence[str] = (KEY, "SK_ID_BUREAU", "SK_ID_PREV"),
                      parallelism: int = 8, max_categories: int = DEFAULT_MAX_CATEGORIES) -> list[dict]:
    """Vocabularies of every string column, one dict (and one job) per
    table, the jobs submitted concurrently from driver threads.  Tables are
    kept apart: the same column name can hold other values elsewhere."""
    from concurrent.futures import ThreadPoolExecutor
    jobs = [(f, string_columns(f, exclude=exclude)) for f in frames]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda fc: small_vocabularies(fc[0], fc[1], max_categories), jobs))


def full_features(tables: Mapping[str, DataFrame], nan_as_category: bool = True,
                  vocabularies: Mapping[str, Mapping[str, Sequence]] | None = None,
                  max_categories: int = DEFAULT_MAX_CATEGORIES) -> DataFrame:
    """All seven tables -> one feature row per application.

    ``tables`` holds ``application, bureau, bureau_balance,
    previous_application, POS_CASH_balance, installments_payments,
    credit_card_balance``; missing children are skipped.  ``vocabularies``
    maps a table name to its column vocabularies (e.g. from training);
    otherwise they are collected, one concurrent job per table.
    """
    names = list(tables)
    if vocabularies is None:
        vocabularies = dict(zip(names, plan_vocabularies([tables[n] for n in names], max_categories=max_categories)))
    voc = {n: dict(vocabularies.get(n, {})) for n in names}
    bound = {"max_categories": max_categories}
    app = application_features(tables["application"], False, voc["application"], **bound)
    kids = []
    if "bureau" in tables and "bureau_balance" in tables:
        kids.append(bureau_features(tables["bureau"], tables["bureau_balance"], nan_as_category,
                                    {**voc["bureau"], **voc["bureau_balance"]}, **bound))
    folds = {"previous_application": previous_features, "POS_CASH_balance": pos_features,
             "installments_payments": installments_features, "credit_card_balance": credit_card_features}
    kids += [fold(tables[n], nan_as_category, voc[n], **bound) for n, fold in folds.items() if n in tables]
    return assemble(app, kids)


# -- P8 exploratory features --------------------------------------------------------------

# The exploratory bins (right-closed) and their labels.
AGE_BINS = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["<25", "25-35", "35-45", "45-55", "55-65", "65+"]
CREDIT_RATIO_BINS = [0, 2, 4, 6, 8, 10, 100]
CREDIT_RATIO_LABELS = ["0-2", "2-4", "4-6", "6-8", "8-10", "10+"]
EXT_SOURCE_BINS = [0, 0.2, 0.4, 0.6, 0.8, 1.0]
EXT_SOURCE_LABELS = ["0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
EMPLOYED_BINS = [-1, 0, 1, 3, 5, 10, 100]
EMPLOYED_LABELS = ["Sans emploi", "<1 an", "1-3 ans", "3-5 ans", "5-10 ans", "10+ ans"]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


def exploratory_features(app: DataFrame) -> DataFrame:
    """Years from day offsets, financial ratios (x/0 -> null), EXT_SOURCE
    row statistics, document-flag count and right-closed bins; all narrow
    projections (no shuffle)."""
    from ledgerfold.functions.nullsafe import (
        cut_right_closed, days_to_years, rowwise_flag_count, rowwise_max, rowwise_mean,
        rowwise_min, rowwise_product, rowwise_std)
    cols = set(app.columns)
    df = app
    if "DAYS_EMPLOYED" in cols:
        df = df.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED", DAYS_SENTINEL))
    years = {"AGE_YEARS": "DAYS_BIRTH", "EMPLOYED_YEARS": "DAYS_EMPLOYED",
             "REGISTRATION_YEARS": "DAYS_REGISTRATION", "ID_PUBLISH_YEARS": "DAYS_ID_PUBLISH"}
    new: dict[str, Column] = {n: days_to_years(c, -365.25) for n, c in years.items() if c in cols}
    ratios = {
        "CREDIT_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "CREDIT_TERM": ("AMT_CREDIT", "AMT_ANNUITY"),
        "GOODS_PRICE_RATIO": ("AMT_GOODS_PRICE", "AMT_CREDIT"),
        "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "ANNUITY_PER_PERSON": ("AMT_ANNUITY", "CNT_FAM_MEMBERS"),
    }
    for n, (a, b) in ratios.items():
        if a in cols and b in cols:
            new[n] = safe_divide(a, b)
    if "AMT_INCOME_TOTAL" in cols and "CNT_CHILDREN" in cols:
        new["INCOME_PER_CHILD"] = safe_divide("AMT_INCOME_TOTAL", F.col("CNT_CHILDREN") + 1)
    if "EMPLOYED_YEARS" in new and "AGE_YEARS" in new:
        new["EMPLOYED_TO_AGE_RATIO"] = safe_divide(new["EMPLOYED_YEARS"], new["AGE_YEARS"])
    if "AMT_CREDIT" in cols and "AGE_YEARS" in new:
        new["CREDIT_TO_AGE_RATIO"] = safe_divide("AMT_CREDIT", new["AGE_YEARS"])
    ext = [c for c in EXT_SOURCES if c in cols]
    if ext:
        new.update({"EXT_SOURCE_MEAN": rowwise_mean(ext), "EXT_SOURCE_MIN": rowwise_min(ext),
                    "EXT_SOURCE_MAX": rowwise_max(ext), "EXT_SOURCE_STD": rowwise_std(ext),
                    "EXT_SOURCE_PROD": rowwise_product(ext)})
    docs = [c for c in app.columns if "FLAG_DOCUMENT" in c]
    if docs:
        new["DOCUMENT_COUNT"] = rowwise_flag_count(docs)
    if "AGE_YEARS" in new:
        new["AGE_GROUP"] = cut_right_closed(new["AGE_YEARS"], AGE_BINS, AGE_LABELS)
    if "CREDIT_INCOME_RATIO" in new:
        new["CREDIT_RATIO_GROUP"] = cut_right_closed(new["CREDIT_INCOME_RATIO"], CREDIT_RATIO_BINS,
                                                     CREDIT_RATIO_LABELS)
    for c in ext:
        new[f"{c}_GROUP"] = cut_right_closed(c, EXT_SOURCE_BINS, EXT_SOURCE_LABELS)
    if "EMPLOYED_YEARS" in new:
        new["EMPLOYED_GROUP"] = cut_right_closed(new["EMPLOYED_YEARS"], EMPLOYED_BINS,
                                                 EMPLOYED_LABELS)
    return df.select(KEY, *[v.alias(k) for k, v in new.items()])


# -- training / scoring round trip ------------------------------------------------------

def build_feature_table(tables: Mapping[str, DataFrame], path: str, manifest_path: str,
                        nan_as_category: bool = True,
                        max_categories: int = DEFAULT_MAX_CATEGORIES) -> dict:
    """Training side: fold the tables, write the feature table (Parquet) and
    a manifest holding the ordered feature names *and* the vocabularies the
    one-hot/share columns were built from."""
    from ledgerfold.sources.feature_store import write_features, write_manifest
    names = list(tables)
    vocabs = dict(zip(names, plan_vocabularies([tables[n] for n in names], max_categories=max_categories)))
    feats = full_features(tables, nan_as_category, vocabs)
    write_features(feats, path, target="TARGET" if "TARGET" in feats.columns else None)
    return write_manifest(feats, manifest_path, vocabularies=vocabs)


def scoring_features(tables: Mapping[str, DataFrame], manifest: Mapping,
                     nan_as_category: bool = True) -> DataFrame:
    """Scoring side: the same folding with the training vocabularies (no
    vocabulary job; categories unseen in the new data still get their
    columns), ordered as the manifest says; a missing feature raises."""
    from ledgerfold.operators.scoring import prepare_features
    feats = full_features(tables, nan_as_category, manifest.get("vocabularies"))
    out, _ = prepare_features(feats, manifest["feature_names"], KEY)
    return out
