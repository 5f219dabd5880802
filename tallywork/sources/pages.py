"""Stored web pages: links, the portal's list of batches, and the claim rows of its status lists.

Pages are read whole; every match becomes a row through ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import billing, dates

# --- fixed values: patterns of the markup ---------------------------------------
HREF = r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""  # three ways of quoting
LINK = r"(?is)<a\s[^>]*?" + HREF + r"[^>]*>(.*?)</a>"
LIST = r"""(?is)<table(?=[^>]*\salign\s*=\s*["']?center\b)[^>]*>(.*)"""  # and all behind it
TABLES = r"(?i)(?=</?table\b)"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"
TAG = r"<[^>]*>"

# --- fixed values: place of each field among a status row's cells, from 0 -------
TRACE, BATCH, STATUS, LAST, FIRST, ACCOUNT, SERVICED, RECEIVED = 1, 2, 3, 4, 5, 6, 9, 15


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link_text, href) of every link of every page, in page order."""
    links = F.arrays_zip(*[_all("html", LINK, i).alias(x) for i, x in enumerate("abc", 1)],
                         _all("html", LINK, 4).alias("text"))
    return (pages.select("page_id", F.posexplode(links).alias("pos", "link"))
            .select("page_id", "pos", plain(F.col("link.text")).alias("link_text"),
                    F.concat("link.a", "link.b", "link.c").alias("href")))


def plain(markup: Column) -> Column:
    """Text of a cell: without tags, hard blanks and blanks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, TAG, ""), "&nbsp;|\\s+", " "))


def first_list(html: str) -> Column:
    """What is in the first centred table, up to its own end (tables inside it have theirs); without an end,
    up to the page's."""
    pieces = F.split(F.regexp_extract(html, LIST, 1), TABLES)

    def step(state: Column, piece: Column) -> Column:
        start = F.lower(F.substring(piece, 1, 7))
        depth = (state["depth"] + F.when(start == "</table", -1)
                 .when(start.startswith("<table"), 1).otherwise(0))
        ended = (state["depth"] == 0) | (depth == 0)
        return F.struct(F.when(ended, 0).otherwise(depth).cast("int").alias("depth"),
                        F.when(ended, state["n"]).otherwise(state["n"] + 1).cast("int").alias("n"))

    kept = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)["n"]
    return F.array_join(F.slice(pieces, F.lit(1), kept), "")


def _list_rows(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(pos, cells) of the rows of a page's list, without its heading row."""
    return (pages.select(*keep, first_list("html").alias("_list"))
            .select(*keep, F.posexplode(_all("_list", ROW)).alias("pos", "row"))
            .where("pos > 0")
            .select(*keep, "pos", _all("row", CELL).alias("cells")))


def _cell_href(i: int) -> Column:
    return F.concat(*[F.regexp_extract(F.get("cells", F.lit(i)), "(?i)" + HREF, k) for k in (1, 2, 3)])


def extract_batches(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(batch_no, href) of each row of the list of batches."""
    return _list_rows(pages, keep).select(
        *keep, "pos", plain(F.get("cells", F.lit(1))).try_cast("bigint").alias("batch_no"),
        _cell_href(1).alias("href"))


def extract_claim_rows(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Claim rows of status lists: the first centred table of a page, without its heading row.
    ``keep`` names columns of ``pages`` to carry along."""
    rows = _list_rows(pages, keep)

    def text(i: int) -> Column:
        return plain(F.get("cells", F.lit(i)))

    def date(i: int) -> Column:
        return dates.parsed(text(i), "%m/%d/%Y")

    return rows.select(
        *keep, "pos",
        text(TRACE).try_cast("bigint").alias("trace_no"),
        _cell_href(TRACE).alias("href"),
        text(BATCH).try_cast("bigint").alias("batch"), text(STATUS).alias("status"),
        text(LAST).alias("last"), text(FIRST).alias("first"), text(ACCOUNT).alias("acc_no"),
        date(SERVICED).alias("service_date"), date(RECEIVED).alias("date_received"))


def flatten_claims(batches: DataFrame, claims: DataFrame) -> DataFrame:
    """Nine columns per claim of the given batches (``batch_no``)."""
    return (claims.join(batches.select("batch_no"), F.col("batch") == F.col("batch_no"))
            .select("batch_no", "trace_no", "status", "last", "first", "acc_no",
                    billing.account_client(F.col("acc_no")).alias("client_id"),
                    "service_date", "date_received"))


def newer_batches(batches: DataFrame, seen: Column) -> DataFrame:
    """Batches after the last one seen."""
    return batches.where(F.col("batch_no") > seen)


def newest_batch(batches: DataFrame) -> DataFrame:
    return batches.agg(F.max("batch_no").alias("batch_no"))


# ---- result pages made from sent claims ----------------------------------------------

ROWS_PER_PAGE = 25


def render_batches(sent: DataFrame) -> DataFrame:
    """Lists of batches as the portal would show them for claims sent: (year, html), newest first. An upload is
    a month, so a page has at most twelve rows; above each list stands a table of the page's frame."""
    no = F.col("upload_no").cast("string")
    row = F.concat(F.lit("<tr><td>claims</td><td nowrap>&nbsp;<a href='claims?batch_no="), no, F.lit("'>"),
                   no, F.lit("</a></td></tr>"))
    return (sent.select("upload_no").distinct()
            .select(F.floor(F.col("upload_no") / 100).cast("bigint").alias("year"),
                    F.struct("upload_no", row.alias("row")).alias("r"))
            .groupBy("year")
            .agg(F.concat(F.lit("<table valign=center><tr><td>frame</td></tr></table>"
                                "<table border=0 align=Center><tr><td>"
                                "<table>No</table></td><td>Batch</td></tr>"),
                          F.array_join(F.transform(F.sort_array(F.collect_list("r"), asc=False),
                                                   lambda x: x["row"]), "\n"),
                          F.lit("</table><table><tr><td>foot</td></tr></table>")).alias("html")))


def render_results(sent: DataFrame, names: DataFrame) -> DataFrame:
    """Status lists as the portal would show them for claims sent: (upload_no, page_no,
    html), 25 claims a page. ``names``: (client_id, account_no)."""
    received = F.date_format(F.date_add(F.col("items")[0]["session_date"], 21), "M/d/yyyy")
    trace = (F.col("position") * 1000000 + F.col("upload_no")).cast("string")
    texts = {
        0: F.col("position").cast("string"),
        TRACE: F.concat(F.lit("<a href='view?trace_no="), trace, F.lit("'>"), trace, F.lit("</a>")),
        BATCH: F.col("upload_no").cast("string"),
        STATUS: F.when(F.col("client_id") % 9 == 0, "REJECTED").otherwise("ACCEPTED"),
        LAST: F.upper(F.split("client_name", ",")[0]),
        FIRST: F.upper(F.trim(F.split("client_name", ",")[1])),
        ACCOUNT: F.col("account_no"),
        SERVICED: F.date_format(F.col("items")[0]["session_date"], "MM/dd/yyyy"),
        10: F.col("total").cast("string"), RECEIVED: received}
    cells = [F.concat(F.lit('<td class="g">&nbsp;'), texts.get(i, F.lit("")), F.lit("</td>"))
             for i in range(16)]
    row = F.concat(F.lit("<tr bgcolor=ddf7f7 >\n"), *cells, F.lit("</tr>"))
    page = (F.floor((F.col("position") - 1) / ROWS_PER_PAGE) + 1).cast("bigint")
    return (sent.join(names, "client_id")
            .select("upload_no", page.alias("page_no"), F.struct("position", row.alias("row")).alias("r"))
            .groupBy("upload_no", "page_no")  # at most 25 rows each
            .agg(F.concat(F.lit("<table align='Center'><tr><td>No</td></tr>"),
                          F.array_join(F.transform(F.sort_array(F.collect_list("r")),
                                                   lambda x: x["row"]), "\n"),
                          F.lit("</table>")).alias("html")))
