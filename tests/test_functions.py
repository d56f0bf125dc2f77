from pyspark.sql import functions as F

from strandwise.functions import hashing as H, sequence as S


def one(spark, **columns):
    """The values of column expressions over a single row."""
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_sequence_functions(spark):
    lit = F.lit
    got = one(
        spark,
        comp=S.complement(lit("AcgN"), keep_case=True),
        rc=S.revcomp(lit("AACGT")),
        digits=S.encode(lit("acGT")),
        back=S.decode(lit("0123")),
        number=S.as_number(lit("CA")),
        ok=S.is_valid(lit("acgt")),
        bad=S.is_valid(lit("ACN")),
        cut=S.between(lit("ACGTT"), 1, 3),
        at=S.base_at(lit("ACGT"), 2),
        lcp=S.common_prefix(lit("ACGT"), lit("ACTT")),
        all_=S.common_prefix(lit("AC"), lit("ACTT")),
        none=S.common_prefix(lit(""), lit("A")),
        hpc=S.homopolymer_compressed(lit("AACCCGTT")),
        best=S.best_prefix(lit("ACG"), lit("ACGTT")),
        full=S.best_prefix(lit("ACGT"), lit("ACG")),
        toggled=S.toggled(lit("-r1")),
        parts=S.pieces(lit("a,,b,"), ","),
        inside=S.contains_at(lit("ACGT"), lit("GT"), 2),
    )
    assert got == dict(
        comp="TgcN", rc="ACGTT", digits="0123", back="ACGT", number=4, ok=True, bad=False, cut="CG", at="G", lcp=2, all_=2, none=0, hpc="ACGT", best=3, full=3, toggled="r1", parts=["a", "b"], inside=True
    )


def test_longer_text_sorts_before_its_prefix(spark):
    rows = spark.createDataFrame([("AC",), ("ACG",), ("AA",)], "s string")
    assert [r.s for r in rows.orderBy(S.sort_key("s")).collect()] == ["AA", "ACG", "AC"]


def test_hash_literals(spark):
    assert H.inverse() == 9966429156680206042860344150721244687
    assert H.python_hash("T" * 15) == 5977406780511210057657428282126163
    assert H.python_hash("T" * 21) == 313371948199368088788527842586232283107
    got = one(spark, exact=H.decimal_hash(F.lit("T" * 15)).cast("string"), text=H.hash_text(F.lit("T" * 21)), limbs=H.limb_hash(F.lit("T" * 21)))
    assert int(got["exact"]) == H.python_hash("T" * 15)
    assert int(got["text"]) == H.python_hash("T" * 21)
    assert sum(v << (32 * i) for i, v in enumerate(got["limbs"])) == H.python_hash("T" * 21)


def test_rolling_hashes():
    text, k = "ACGTTGCAACGTAGCTAGCTAACGT", 7
    h = H.python_hash(text[:k])
    for i in range(len(text) - k):
        assert H.extend_right(h, text[i + k]) == H.python_hash(text[i : i + k + 1])
        nxt = H.shift_right(h, text[i], text[i + k], k)
        assert nxt == H.python_hash(text[i + 1 : i + k + 1])
        assert H.shift_left(nxt, text[i + k], text[i], k) == h
        h = nxt
    assert H.extend_left(H.python_hash("CG"), "T", 2) == H.python_hash("TCG")
