"""Schemas of the six tables of the store and validation of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACES = ["user_id", "session_id", "project_id", "profile"]


def _struct(spec: str, required: str = "") -> T.StructType:
    must = set(required.split())
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "byte": T.ByteType()}
    kinds |= {"vector": T.ArrayType(T.FloatType()), "tags": T.ArrayType(T.StringType())}
    fields = [x.split(":") for x in spec.split()]
    return T.StructType([T.StructField(n, kinds[k], n not in must) for n, k in fields])


_NS = "user_id:string session_id:string project_id:string profile:string "
_MEMORY = "memory_id:string memory_role:string memory_root_path:string "

TABLES = {
    "embeddings": _struct(
        "hash_seq:string content_hash:string collection:string file_path:string content_type:string title:string text_body:string "
        "seq:int pos:int model:string embedded_at:long vector:vector " + _NS + _MEMORY
        + "importance:float ttl_seconds:int tags:tags expires_at:long active:byte index_batch_id:string file_key:string chunk_id:string chars:int",
        "hash_seq content_hash collection file_path content_type seq pos embedded_at",
    ),
    "documents": _struct(
        "id:string collection:string file_path:string title:string content_hash:string content_type:string active:byte "
        "created_at:long updated_at:long " + _NS + _MEMORY + "index_batch_id:string",
        "id collection file_path content_hash content_type active created_at updated_at",
    ),
    "content": _struct("hash:string doc:string content_type:string created_at:long", "hash doc content_type created_at"),
    "entities": _struct(
        "id:string collection:string entity_key:string name:string entity_type:string " + _MEMORY + _NS
        + "file_path:string content_hash:string hash_seq:string seq:int evidence:string created_at:long active:byte index_batch_id:string",
        "id collection entity_key name entity_type file_path content_hash hash_seq seq created_at",
    ),
    "relations": _struct(
        "id:string collection:string subject_key:string subject_name:string object_key:string object_name:string relation_type:string "
        "evidence:string " + _MEMORY + _NS + "file_path:string content_hash:string hash_seq:string seq:int created_at:long active:byte index_batch_id:string",
        "id collection subject_key subject_name object_key object_name relation_type",
    ),
    "cache": _struct("key:string value:string created_at:long used_at:long", "key value created_at"),
}

# Characters and sequences that names must not hold.
REJECTED = ["'", '"', ";", "\\", "\n", "\r", "\0", "\x1a", "--", "/*", "*/"]


def checked_name(value: str, what: str = "value") -> str:
    """value if it is a usable name; ValueError for blank ones and for quotes, comments and control characters."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must be a non-empty string")
    if bad := next((x for x in REJECTED if x in value), None):
        raise ValueError(f"{what} holds {bad!r}")
    return value


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the columns of a table: missing ones null, tags decoded, others dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in TABLES[table].fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name == "tags" and isinstance(have["tags"], T.StringType):
            out.append(decoded_tags(F.col("tags")).alias("tags"))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def decoded_tags(raw):
    """Tags from a JSON list, or from comma-separated text where it is none."""
    listed = F.from_json(raw, "array<string>")
    plain = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(raw).startswith("["), listed).otherwise(plain)
