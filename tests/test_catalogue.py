import pytest
from conftest import SF, same

from packrow.plans import catalogue

#: A few of each kind; the driver runs all of them against their oracle.
CHOSEN = [
    "header_errors", "decode_fixed", "encode_columns", "decode_lineitem", "null_sentinels", "match_and", "compare_nulls_first", "compare_decimal", "bitset_flags", "strings_chain",
    "group_explode", "group_entry_at", "group_framed", "lookup_map_last_wins", "batch_padded", "batch_typed_frames", "batch_by_type", "dispatch_mixed", "transcode_validated",
    "evolve_group_pad", "evolve_missing_group", "decode_errors", "validate_errors", "coerce_strings", "schema_diff", "sql_readers",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_oracle(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLE_SQL[name])


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
