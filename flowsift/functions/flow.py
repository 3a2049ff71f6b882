"""Engineered flow features."""

from pyspark.sql import Column, functions as F


def _ratio(over, under) -> Column:
    return F.try_divide(F.col(over).cast("double"), F.col(under).cast("double") + 1)


def _per_second(a, b, dur) -> Column:
    total = F.col(a).cast("double") + F.col(b).cast("double")
    return F.try_divide(total, F.col(dur).cast("double") + 1e-6)


def byte_ratio(sbytes: str = "sbytes", dbytes: str = "dbytes") -> Column:
    return _ratio(sbytes, dbytes)


def pkt_ratio(spkts: str = "Spkts", dpkts: str = "Dpkts") -> Column:
    return _ratio(spkts, dpkts)


def flow_rate(sbytes: str = "sbytes", dbytes: str = "dbytes", dur: str = "dur") -> Column:
    return _per_second(sbytes, dbytes, dur)


def pkt_rate(spkts: str = "Spkts", dpkts: str = "Dpkts", dur: str = "dur") -> Column:
    return _per_second(spkts, dpkts, dur)
