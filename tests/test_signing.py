import hashlib
import hmac

from pyspark.sql import functions as F

from kinograph.functions.signing import hmac_sha256


def test_hmac_is_the_standard_one(spark):
    for key in (b"k", b"x" * 64, b"long" * 40, b""):
        got = spark.range(1).select(hmac_sha256(key, F.lit("v1:1:{}")).alias("h")).first().h
        assert got == hmac.new(key, b"v1:1:{}", hashlib.sha256).hexdigest()
