"""Types of the URL-state log and of the page store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type codes of a URL state.
NOTHING, KNOW, REDIRECT = 0, 1, 2
FILE_ROBOTS, FILE_HTML, FILE_RSS, FILE_SITEMAP, FILE_FAVICON = 3, 4, 5, 6, 7
ERROR_NETWORK, ERROR_PARSING, ERROR_FILTER_URL, ERROR_FILTER_PAGE, ERROR_ROBOT, ERROR_NO_INDEX = 128, 129, 130, 131, 132, 133

STATE_NAMES = {
    0: "nothing", 1: "know", 2: "redirect", 3: "fileRobots", 4: "fileHTML", 5: "fileRSS", 6: "fileSitemap",
    7: "fileFavicon", 128: "errorNetwork", 129: "errorParsing", 130: "errorFilterURL", 131: "errorFilterPage",
    132: "errorRobot", 133: "errorNoIndex",
}

STATE_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("state_type", T.ShortType()),
        T.StructField("state_time", T.TimestampType()),
        T.StructField("dest_key", T.StringType()),
        T.StructField("blob_position", T.LongType()),
        T.StructField("blob_length", T.IntegerType()),
    ]
)

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("ns", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("elem_id", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)

META = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("no_follow", T.BooleanType()),
        T.StructField("no_index", T.BooleanType()),
        T.StructField("og_title", T.StringType()),
        T.StructField("og_image", T.StringType()),
        T.StructField("og_description", T.StringType()),
        T.StructField("og_locale", T.StringType()),
        T.StructField("og_site_name", T.StringType()),
        T.StructField("linked_data", T.ArrayType(T.StringType())),
    ]
)


def is_file(state: Column) -> Column:
    return (state >= 3) & (state < 128)


def is_error(state: Column) -> Column:
    return state >= 128


def state_name(state: Column) -> Column:
    pairs = [x for k, v in STATE_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[state.cast("int")], F.concat(F.lit("type"), state.cast("string")))
