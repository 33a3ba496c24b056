"""Fit the models that ship with this subpackage: python -m lodescan.llm.train DATA_DIR [language] [pii]."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lodescan.llm import language, pii, pii_synthetic
from lodescan.runtime import session, ship, table

#: bounds of the samples the models are fitted on
DOCUMENTS_PER_LANGUAGE, PII_TEXTS, PII_VALUES = 150, 12_000, 40_000
#: columns whose names say what their values are
PII_COLUMNS = ("full_name", "phone", "ssn", "address", "email", "company", "project", "dataset", "ref", "remark", "city")
STAND_INS = ("n/a", "none", "null", "-", "")


def main(sf_dir: str, *what: str) -> None:
    spark = session(master="local[8]")
    ship(spark)
    here = Path(__file__).parent / "models"
    here.mkdir(exist_ok=True)
    if not what or "language" in what:
        fitted = language.train(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", DOCUMENTS_PER_LANGUAGE)
        np.save(here / "language_prototypes.npy", fitted)
    if not what or "pii" in what:
        leaf = F.regexp_extract("cell_key", r"([^.\[\]]+)$", 1)
        cells = table(spark, sf_dir, "cells").where(leaf.isin(*PII_COLUMNS) & (F.col("cell_value") != ""))
        rows = cells.orderBy(F.xxhash64("cell_id")).limit(PII_VALUES).select(leaf.alias("k"), F.col("cell_value").alias("v")).toPandas()
        # values of ordinary characters that are no stand-ins for nothing
        plain = rows[[pii.flattened(v)[1] is None and v.strip().lower() not in STAND_INS for v in rows["v"]]]
        columns = {k: plain[plain["k"] == k]["v"].tolist() for k in PII_COLUMNS}
        made = list(pii_synthetic.texts(columns, PII_TEXTS, 3, held_out=False))
        model = pii.fit(made, pii.learn_given(rows[rows["k"] == "full_name"]["v"]))
        model.save(str(here / "pii_crf.npz"))
        held_out = list(pii_synthetic.texts(columns, 2000, 9, held_out=True))
        for ties in (True, False):
            print("held-out templates,", "with" if ties else "without", "ties: recall %.4f, precision %.4f" % pii.agreement(held_out, pii.entities([t for t, _ in held_out], model, ties)))


if __name__ == "__main__":
    main(*sys.argv[1:])
