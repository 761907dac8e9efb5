"""Seven-table fixture with the edge rows of FIXTURES.md §1."""

import math

import pytest

from ledgerfold.plans import features as FE


@pytest.fixture(scope="module")
def tables(spark):
    app = spark.createDataFrame([
        (1, "M", "Y", "N", "Cash loans", 100.0, 200.0, 10.0, 2.0, -10000, 365243),
        (2, "F", "N", "Y", "Revolving loans", 50.0, 0.0, 5.0, 0.0, -12000, -100),
        (3, None, "N", "N", "Cash loans", 0.0, 0.0, 0.0, 1.0, -9000, -50),
        (4, "XNA", "Y", "Y", "Cash loans", 1.0, 1.0, 1.0, 1.0, -9000, -50),
    ], "SK_ID_CURR long, CODE_GENDER string, FLAG_OWN_CAR string, FLAG_OWN_REALTY string, "
       "NAME_CONTRACT_TYPE string, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, "
       "CNT_FAM_MEMBERS double, DAYS_BIRTH int, DAYS_EMPLOYED int")
    bureau = spark.createDataFrame([
        (10, 1, "Active", "Consumer", -100, 1000.0, None), (11, 1, "Closed", "Consumer", -200, 500.0, None),
        (12, 2, "Closed", "Car", -300, None, None), (13, 3, "Active", "Car", -50, 70.0, 1.0),
    ], "SK_ID_BUREAU long, SK_ID_CURR long, CREDIT_ACTIVE string, CREDIT_TYPE string, DAYS_CREDIT int, "
       "AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double")
    bb = spark.createDataFrame([(10, 0, "C"), (10, -1, "0"), (11, 0, "X"), (13, -2, "C")],
                               "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    prev = spark.createDataFrame([
        (100, 1, "Approved", 10.0, 5.0, 365243), (101, 1, "Refused", 0.0, 0.0, -5), (102, 2, "Canceled", 3.0, 3.0, -1),
    ], "SK_ID_PREV long, SK_ID_CURR long, NAME_CONTRACT_STATUS string, AMT_APPLICATION double, "
       "AMT_CREDIT double, DAYS_FIRST_DUE int")
    pos = spark.createDataFrame([(100, 1, -1, 0, 0, "Active"), (100, 1, -2, 5, 0, None)],
                                "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, SK_DPD int, "
                                "SK_DPD_DEF int, NAME_CONTRACT_STATUS string")
    ins = spark.createDataFrame([
        (100, 1, 1.0, -10, -12, 100.0, 100.0), (100, 1, 2.0, -20, None, 50.0, None),
        (101, 2, 1.0, -5, -1, 0.0, 10.0)],
        "SK_ID_PREV long, SK_ID_CURR long, NUM_INSTALMENT_VERSION double, DAYS_INSTALMENT int, "
        "DAYS_ENTRY_PAYMENT int, AMT_INSTALMENT double, AMT_PAYMENT double")
    cc = spark.createDataFrame([(100, 1, -1, 10.0, "Active"), (100, 1, -2, 30.0, "Active")],
                               "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double, "
                               "NAME_CONTRACT_STATUS string")
    return {"application": app, "bureau": bureau, "bureau_balance": bb, "previous_application": prev,
            "POS_CASH_balance": pos, "installments_payments": ins, "credit_card_balance": cc}


def test_application(spark, tables):
    out = {r.SK_ID_CURR: r for r in FE.application_features(tables["application"]).collect()}
    assert set(out) == {1, 2, 3}                  # XNA dropped, null gender kept
    assert out[1].CODE_GENDER == 0 and out[2].CODE_GENDER == 1 and out[3].CODE_GENDER == -1
    assert out[1].DAYS_EMPLOYED is None and out[1].DAYS_EMPLOYED_PERC is None
    assert out[2].INCOME_CREDIT_PERC is None and out[2].INCOME_PER_PERSON is None  # x/0
    assert out[3].INCOME_CREDIT_PERC is None  # 0/0
    assert out[1]["NAME_CONTRACT_TYPE_Cash loans"] == 1


def test_bureau(spark, tables):
    b = {r.SK_ID_CURR: r for r in FE.bureau_features(tables["bureau"], tables["bureau_balance"]).collect()}
    assert b[2].ACTIVE_DAYS_CREDIT_MIN is None             # only closed credits
    assert b[2].BURO_AMT_CREDIT_SUM_SUM == 0.0             # all-null amounts sum to 0
    assert b[1].BURO_AMT_CREDIT_SUM_DEBT_SUM == 0.0
    assert b[3].BURO_DAYS_CREDIT_VAR is None               # single credit
    assert b[1].BURO_DAYS_CREDIT_VAR == 5000.0
    assert math.isclose(b[1].BURO_CREDIT_ACTIVE_Active_MEAN, 0.5)
    assert b[1].BURO_MONTHS_BALANCE_SIZE_SUM == 3
    assert math.isclose(b[1].BURO_STATUS_C_MEAN_MEAN, 0.25)  # mean(0.5, 0)
    assert b[2].BURO_MONTHS_BALANCE_SIZE_MEAN is None       # credit without balances


def test_children_and_full(spark, tables):
    p = {r.SK_ID_CURR: r for r in FE.previous_features(tables["previous_application"]).collect()}
    assert p[1].PREV_APP_CREDIT_PERC_MAX == 2.0 and p[1].REFUSED_AMT_APPLICATION_MIN == 0.0
    assert p[2].APPROVED_AMT_APPLICATION_MEAN is None
    i = {r.SK_ID_CURR: r for r in FE.installments_features(tables["installments_payments"]).collect()}
    assert i[1].INSTAL_DPD_MAX == 0 and i[1].INSTAL_DBD_SUM == 2    # missed payment stays null
    assert i[1].INSTAL_COUNT == 2 and i[2].INSTAL_PAYMENT_PERC_MAX is None
    full = FE.full_features(tables)
    rows = {r.SK_ID_CURR: r for r in full.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[3].POS_COUNT is None and rows[1].POS_COUNT == 2      # client without child rows
    assert rows[1].CC_AMT_BALANCE_VAR == 200.0
    assert all(" " not in c and "-" not in c for c in full.columns)
    prefixes = {c.split("_")[0] for c in full.columns}
    assert {"BURO", "ACTIVE", "CLOSED", "PREV", "APPROVED", "REFUSED", "POS", "INSTAL", "CC"} <= prefixes


def test_exploratory(spark, tables):
    e = {r.SK_ID_CURR: r for r in FE.exploratory_features(tables["application"]).collect()}
    assert math.isclose(e[1].AGE_YEARS, 10000 / 365.25)
    assert e[1].AGE_GROUP == "25-35" and e[1].EMPLOYED_YEARS is None


def test_train_then_score_with_manifest_vocabularies(spark, tables, tmp_path):
    from ledgerfold.sources.feature_store import read_manifest
    m = FE.build_feature_table(tables, str(tmp_path / "feat"), str(tmp_path / "manifest"))
    m = read_manifest(spark, str(tmp_path / "manifest"))
    assert "vocabularies" in m and m["vocabularies"]["bureau"]["CREDIT_TYPE"] == ["Car", "Consumer"]
    # new data for one client only: 'Car' credits and most categories are absent
    new = {k: (v.where("SK_ID_CURR = 1") if "SK_ID_CURR" in v.columns else v) for k, v in tables.items()}
    s = FE.scoring_features(new, m)
    assert s.columns == ["SK_ID_CURR"] + m["feature_names"]
    r = s.first()
    assert r.BURO_CREDIT_TYPE_Car_MEAN == 0.0 and r.SK_ID_CURR == 1
