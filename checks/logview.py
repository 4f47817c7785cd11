"""Log lines rendered from the ``events`` table, the same text in both engines.

Every event becomes one to four lines of its user's log, 0, 1.25, 3.5 and 45 seconds
after it, in one of seven timestamp layouts; some lines carry none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks import table
from faultline.operators import segmented as seg

BOOT = "2024-01-01 00:00:00"
BOOT_US = 1704067200000000
YEAR = 2024

_DIALECT = {
    "spark": {
        "us": "unix_micros(cast(ts AS timestamp))",
        "ymd": "date_format(timestamp_micros(us), 'yyyy-MM-dd')",
        "slash": "date_format(timestamp_micros(us), 'yyyy/MM/dd')",
        "md": "date_format(timestamp_micros(us), 'MM-dd')",
        "month": "date_format(timestamp_micros(us), 'MMM dd')",
        "hms": "date_format(timestamp_micros(us), 'HH:mm:ss')",
        "lines": "LATERAL VIEW explode(sequence(0, cast(event_id % 4 AS int))) v AS k",
    },
    "duckdb": {
        "us": "epoch_us(ts)",
        "ymd": "strftime(make_timestamp(us), '%Y-%m-%d')",
        "slash": "strftime(make_timestamp(us), '%Y/%m/%d')",
        "md": "strftime(make_timestamp(us), '%m-%d')",
        "month": "strftime(make_timestamp(us), '%b %d')",
        "hms": "strftime(make_timestamp(us), '%H:%M:%S')",
        "lines": ", unnest(range(event_id % 4 + 1)) AS v(k)",
    },
}

_TEMPLATE = """
SELECT log_id, us, event_id, k,
  CASE
    WHEN k > 0 AND (event_id + k) % 5 = 4 THEN '    at '
    WHEN event_id % 7 = 0 THEN concat('[', cast(cast(floor((us - {boot}) / 1000000) AS bigint) AS {str}), '.', frac, '] ')
    WHEN event_id % 7 = 1 THEN concat({ymd}, 'T', {hms}, '.', frac, 'Z ')
    WHEN event_id % 7 = 2 THEN concat('[SCPL] ERROR ', {ymd}, ' ', {hms}, '.', frac, ' ')
    WHEN event_id % 7 = 3 THEN concat({slash}, ' ', {hms}, '.', frac, ' ')
    WHEN event_id % 7 = 4 THEN concat({md}, ' ', {hms}, '.', frac, ' ')
    WHEN event_id % 7 = 5 THEN concat({month}, ' ', {hms}, ' ')
    ELSE concat('dtv_svc[', cast(100 + k AS {str}), ']: [', {ymd}, ' ', {hms}, '.', frac, '] ')
  END || CASE event_type
    WHEN 'error' THEN CASE k
      WHEN 0 THEN concat('[ERROR] loki[', id, ']: SIGSEGV null pointer in LAUNCHER at 0x', lower(hex(event_id + 4096)))
      WHEN 1 THEN concat('ERROR MTK VDEC crash decode status=503 pid=', id)
      WHEN 2 THEN concat('WARN companion server timeout after 500 ms from 192.168.1.', cast(event_id % 200 AS {str}))
      ELSE 'FATAL Kernel panic - not syncing: Oops: watchdog timeout' END
    WHEN 'click' THEN CASE k
      WHEN 0 THEN concat('INFO FOCUS lost focus, focus lost on BUTTON_', cast(event_id % 9 AS {str}))
      WHEN 1 THEN concat('WARNING fetch timeout http_status=504 port=8080 in ', cast(event_id % 3 AS {str}), ' tries')
      WHEN 2 THEN 'ERROR MediaKeySession error EME drm fail'
      ELSE 'DEBUG keydown not fired' END
    WHEN 'view' THEN CASE k
      WHEN 0 THEN concat('INFO VIEW session ', id, ' opened uid=1000')
      WHEN 1 THEN 'WARN audio mode mismatch, audio error PCM'
      WHEN 2 THEN 'NOTICE no sound reported'
      ELSE 'ERR DNS fail for HOST dns.example.com' END
    WHEN 'signup' THEN CASE k
      WHEN 0 THEN concat('TRACE signup form 0e09c8f7-fd23-4c52-a853-c371', lpad(lower(hex(event_id)), 8, '0'))
      WHEN 1 THEN 'INFO heap exhausted RETRY'
      WHEN 2 THEN '[WARNING] HDCP handshake fail'
      ELSE 'ERROR network error connection timeout' END
    ELSE CASE k
      WHEN 0 THEN concat('INFO PURCHASE total ', id, ' 200 HTTP ok')
      WHEN 1 THEN concat('WARNING mali GPU hang JOB_', cast(event_id % 5 AS {str}))
      WHEN 2 THEN 'ERROR watchfree deeplink lost contentid'
      ELSE 'CRIT firmware version incompatible v1.2.3' END
  END AS line
FROM (
  SELECT log_id, event_id, event_type, k, us, cast(event_id AS {str}) AS id,
         lpad(cast(us % 1000000 AS {str}), 6, '0') AS frac
  FROM (
    SELECT concat('log-', cast(user_id AS {str})) AS log_id, event_id, event_type, k,
           {us} + CASE k WHEN 0 THEN 0 WHEN 1 THEN 1250000 WHEN 2 THEN 3500000 ELSE 45000000 END AS us
    FROM {events} {lines}
  ) a
) b
"""


def _render(dialect: str, events: str) -> str:
    return _TEMPLATE.format(boot=BOOT_US, str="string" if dialect == "spark" else "varchar",
                            events=events, **_DIALECT[dialect])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, line_no, line, us, event_id, k)`` with dense 1-based line numbers per log."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    rows = spark.sql(_render("spark", "{events}"), events=events)
    day = seg.F.floor(seg.F.col("us") / 86_400_000_000).cast("bigint")
    return seg.number_rows(rows, ["log_id"], ["us", "event_id", "k"], "line_no", day)


LINES_SQL = f"""lines AS (
  SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY us, event_id, k) AS line_no
  FROM ({_render('duckdb', 'events')}) t
)"""
