"""robots.txt rules applied to a column of addresses."""

from __future__ import annotations

import urllib.robotparser

import pandas as pd
from pyspark.sql import Column, functions as F

from lekhya.operators.ingest import url_host


def can_fetch(url: Column, rules: dict[str, str], agent: str = "*") -> Column:
    """Whether ``agent`` may fetch the address; hosts without known rules are open.

    ``rules``: robots.txt text by host (the hosts a crawl is configured for).
    """
    @F.pandas_udf("boolean")
    def check(hosts: pd.Series, urls: pd.Series) -> pd.Series:
        parsers = {}
        for host, text in rules.items():
            parsers[host] = urllib.robotparser.RobotFileParser()
            parsers[host].parse(text.splitlines())
        return pd.Series([parsers[h].can_fetch(agent, u) if h in parsers else True
                          for h, u in zip(hosts, urls)])

    return check(url_host(url), url)
