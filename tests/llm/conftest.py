import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, extra=()):
        """rows of (doc_id, text[, source]); extra: columns with names that the operators use inside."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(f"mine {c}") for c in extra}) if extra else df

    return make
