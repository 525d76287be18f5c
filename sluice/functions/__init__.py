"""Functions as Column expressions."""

from sluice.functions.dialect import date_diff, epoch, list_value, nullifzero, regexp_matches, strftime, strptime, time_bucket, trunc

__all__ = ["date_diff", "epoch", "list_value", "nullifzero", "regexp_matches", "strftime", "strptime", "time_bucket", "trunc"]
