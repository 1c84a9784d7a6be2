from pyspark.sql import functions as F

from strandline.functions import urls

AS_OF = F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")


def test_a_late_day_is_not_read_as_its_month(one):
    day = lambda u: one(urls.infer_date(F.lit(u), AS_OF).cast("string"))
    assert day("https://a.org/2025/03/15/x") is None          # after as_of: not the first of March
    assert day("https://a.org/2025/03/01/x") == "2025-03-01"
    assert day("https://a.org/2025/03/x") == "2025-03-01"
    assert day("https://a.org/2025/02/2025/x") == "2025-02-01"
