"""The one schema that all sources give and all sinks take."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())])
TAGS = T.MapType(T.StringType(), T.StringType(), valueContainsNull=False)
ELEMENT = T.StructType(
    [
        T.StructField("type", T.StringType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("version", T.IntegerType()),
        T.StructField("changeset", T.LongType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("user", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("visible", T.BooleanType()),
        T.StructField("tags", TAGS, False),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("members", T.ArrayType(MEMBER)),
    ]
)
COLUMNS = ELEMENT.names
TYPES = ("node", "way", "relation")


@dataclass(frozen=True)
class Metadata:
    """What a document says of itself; every part may be missing."""

    version: str | None = None
    generator: str | None = None
    copyright: str | None = None
    license: str | None = None
    timestamp: str | None = None

    def as_dict(self) -> dict[str, str | None]:
        return asdict(self)


def conform(frame: DataFrame) -> DataFrame:
    """The columns of ELEMENT in its order and types; those that ``frame`` lacks are null, missing tags an empty map."""
    have = set(frame.columns)
    out = []
    for field in ELEMENT:
        kind = "map<string,string>" if field.name == "tags" else field.dataType
        c = F.col(f"`{field.name}`").cast(kind) if field.name in have else F.lit(None).cast(kind)
        if field.name == "tags":
            c = F.coalesce(c, F.expr("cast(map() as map<string,string>)"))
        out.append(c.alias(field.name))
    return frame.select(*out)
