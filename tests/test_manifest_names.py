"""Golden names: the seven-table pipeline, fed a tiny
fixture that carries a training run's full vocabularies, must yield exactly
that run's feature manifest names, in order.

Point ``GOLDEN_FEATURE_MANIFEST`` at a manifest JSON (``feature_names``
list); the test is skipped without it.  The fixture tables and vocabularies
are derived from the manifest by rule, nothing is copied into this
repository.
"""

import json
import os

import pytest

from ledgerfold.plans import features as FE

MANIFEST = os.environ.get("GOLDEN_FEATURE_MANIFEST", "")

# Categorical columns of the source tables (schema constants).
APP_ONE_HOT = ["NAME_CONTRACT_TYPE", "NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
               "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE",
               "WEEKDAY_APPR_PROCESS_START", "ORGANIZATION_TYPE", "FONDKAPREMONT_MODE",
               "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE"]
BUREAU_CATS = ["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"]
PREV_CATS = ["NAME_CONTRACT_TYPE", "WEEKDAY_APPR_PROCESS_START", "FLAG_LAST_APPL_PER_CONTRACT",
             "NAME_CASH_LOAN_PURPOSE", "NAME_CONTRACT_STATUS", "NAME_PAYMENT_TYPE",
             "CODE_REJECT_REASON", "NAME_TYPE_SUITE", "NAME_CLIENT_TYPE", "NAME_GOODS_CATEGORY",
             "NAME_PORTFOLIO", "NAME_PRODUCT_TYPE", "CHANNEL_TYPE", "NAME_SELLER_INDUSTRY",
             "NAME_YIELD_GROUP", "PRODUCT_COMBINATION"]
RATIOS = ["DAYS_EMPLOYED_PERC", "INCOME_CREDIT_PERC", "INCOME_PER_PERSON", "ANNUITY_INCOME_PERC",
          "PAYMENT_RATE"]
BLOCKS = ["BURO_", "ACTIVE_", "CLOSED_", "PREV_", "APPROVED_", "REFUSED_", "POS_", "INSTAL_", "CC_"]


def _block(names, prefix):
    return [n for n in names if n.startswith(prefix)]


def _share_vocab(names, prefix, cats, suffix="_MEAN"):
    """{cat: [values]} from names ``<prefix><cat>_<value><suffix>`` (longest
    category name first, ``nan`` left out)."""
    out = {c: [] for c in cats}
    for n in names:
        if not (n.startswith(prefix) and n.endswith(suffix)):
            continue
        body = n[len(prefix):-len(suffix)]
        for c in sorted(cats, key=len, reverse=True):
            if body.startswith(c + "_"):
                v = body[len(c) + 1:]
                if v != "nan":
                    out[c].append(v)
                break
    return out


def _rows(n, cols, cats, vocabs, key_of):
    """n rows: numeric columns get i, categorical columns cycle their vocabulary."""
    rows = []
    for i in range(n):
        r = [key_of(i)]
        for c in cols:
            if c in cats:
                vs = vocabs.get(c) or ["A", "B"]
                r.append(vs[i % len(vs)])
            else:
                r.append(float(i % 7) - 3.0)
        rows.append(r)
    return rows


@pytest.mark.skipif(not MANIFEST or not os.path.exists(MANIFEST),
                    reason="set GOLDEN_FEATURE_MANIFEST to a feature manifest JSON")
def test_full_pipeline_reproduces_manifest(spark):
    names = json.load(open(MANIFEST))["feature_names"]
    first_child = min(names.index(next(n for n in names if n.startswith(b))) for b in BLOCKS)
    app_names = names[:first_child]
    # -- application: plain columns (incl. the three binary ones), then one-hot groups
    app_vocab = {c: [] for c in APP_ONE_HOT}
    plain = []
    for n in app_names:
        if n in RATIOS:
            continue
        cat = next((c for c in sorted(APP_ONE_HOT, key=len, reverse=True) if n.startswith(c + "_")), None)
        if cat:
            app_vocab[cat].append(n[len(cat) + 1:])
        else:
            plain.append(n)
    binary = {"CODE_GENDER": ["F", "M"], "FLAG_OWN_CAR": ["N", "Y"], "FLAG_OWN_REALTY": ["N", "Y"]}
    app_cols = plain + APP_ONE_HOT
    cats = set(APP_ONE_HOT) | set(binary)
    rows = [[i, i % 2] + r[1:] for i, r in enumerate(
        _rows(60, app_cols, cats, {**app_vocab, **binary}, lambda i: i))]
    schema = "SK_ID_CURR long, TARGET int, " + ", ".join(
        f"`{c}` {'string' if c in cats else 'double'}" for c in app_cols)
    app = spark.createDataFrame(rows, schema)

    # -- bureau + balances
    buro = _block(names, "BURO_")
    bu_vocab = _share_vocab(buro, "BURO_", BUREAU_CATS)
    status = _share_vocab(buro, "BURO_", ["STATUS"], "_MEAN_MEAN")
    bu_num = [c for c in FE.BUREAU_SPEC if not c.startswith("MONTHS_BALANCE")]
    bu_cols = bu_num + BUREAU_CATS
    bureau = spark.createDataFrame(
        [[i, i % 60] + r[1:] for i, r in enumerate(_rows(40, bu_cols, set(BUREAU_CATS), bu_vocab, lambda i: i))],
        "SK_ID_BUREAU long, SK_ID_CURR long, " + ", ".join(
            f"{c} {'string' if c in BUREAU_CATS else 'double'}" for c in bu_cols))
    bb = spark.createDataFrame([(i % 40, -i, status["STATUS"][i % len(status["STATUS"])]) for i in range(80)],
                               "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string")

    # -- previous applications
    prev_vocab = _share_vocab(_block(names, "PREV_"), "PREV_", PREV_CATS)
    prev_num = ["AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE",
                "HOUR_APPR_PROCESS_START", "RATE_DOWN_PAYMENT", "DAYS_DECISION", "CNT_PAYMENT"]
    prev_cols = prev_num + PREV_CATS
    prev = spark.createDataFrame(
        [[i, i % 60] + r[1:] for i, r in enumerate(_rows(40, prev_cols, set(PREV_CATS), prev_vocab, lambda i: i))],
        "SK_ID_PREV long, SK_ID_CURR long, " + ", ".join(
            f"{c} {'string' if c in PREV_CATS else 'double'}" for c in prev_cols))

    # -- POS, instalments, card balances
    pos_vocab = _share_vocab(_block(names, "POS_"), "POS_", ["NAME_CONTRACT_STATUS"])
    pos_cols = list(FE.POS_SPEC) + ["NAME_CONTRACT_STATUS"]
    pos = spark.createDataFrame(
        [[i, i % 60] + r[1:] for i, r in enumerate(_rows(30, pos_cols, {"NAME_CONTRACT_STATUS"}, pos_vocab, lambda i: i))],
        "SK_ID_PREV long, SK_ID_CURR long, " + ", ".join(
            f"{c} {'string' if c == 'NAME_CONTRACT_STATUS' else 'double'}" for c in pos_cols))
    ins_cols = ["NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]
    ins = spark.createDataFrame(
        [[i, i % 60] + r[1:] for i, r in enumerate(_rows(30, ins_cols, set(), {}, lambda i: i))],
        "SK_ID_PREV long, SK_ID_CURR long, " + ", ".join(f"{c} double" for c in ins_cols))
    cc_names = _block(names, "CC_")
    cc_num = [n[3:-4] for n in cc_names if n.endswith("_MIN")]
    cc_vocab = _share_vocab(cc_names, "CC_", ["NAME_CONTRACT_STATUS"])
    cc_cols = cc_num + ["NAME_CONTRACT_STATUS"]
    cc = spark.createDataFrame(
        [[i, i % 60] + r[1:] for i, r in enumerate(_rows(30, cc_cols, {"NAME_CONTRACT_STATUS"}, cc_vocab, lambda i: i))],
        "SK_ID_PREV long, SK_ID_CURR long, " + ", ".join(
            f"{c} {'string' if c == 'NAME_CONTRACT_STATUS' else 'double'}" for c in cc_cols))

    vocabularies = {"application": app_vocab, "bureau": bu_vocab, "bureau_balance": status,
                    "previous_application": prev_vocab, "POS_CASH_balance": pos_vocab,
                    "installments_payments": {}, "credit_card_balance": cc_vocab}
    tables = {"application": app, "bureau": bureau, "bureau_balance": bb, "previous_application": prev,
              "POS_CASH_balance": pos, "installments_payments": ins, "credit_card_balance": cc}
    out = FE.full_features(tables, vocabularies=vocabularies)
    got = [c for c in out.columns if c not in ("SK_ID_CURR", "TARGET")]
    assert len(got) == len(names)
    assert got == names
    assert out.count() == 60
