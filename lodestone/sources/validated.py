"""JSON documents under a JSON Schema: the schema becomes a Spark type for what is valid, and checks with reasons for what isn't.

Checks run on parsed variants inside the JVM; nothing is swallowed: a document that fails is kept apart with every reason, `path:rule`
(`json` where it can't be parsed). Understood: type (also lists of types), required, properties, additionalProperties false, items, enum, const, pattern,
minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minItems, maxItems and local references that don't recur.
Formats are notes, as in the standard's default. Rules over several fields are SQL conditions on the typed document.

Defined results: a null document fails as `json`; a rule whose condition is null is broken; rules are only asked of documents that the schema accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, VariantType

_PLAIN = {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "integer": ("BIGINT",)}


def _resolved(schema: dict, whole: dict, seen: tuple = ()) -> tuple[dict, tuple]:
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#/") or ref in seen:
            raise ValueError(f"a reference that isn't local or that recurs: {ref}")
        seen, schema = (*seen, ref), whole
        for step in ref[2:].split("/"):
            schema = schema[step.replace("~1", "/").replace("~0", "~")]
    return schema, seen


def _types(schema: dict) -> list[str]:
    found = schema.get("type", [])
    return [found] if isinstance(found, str) else list(found)


def spark_type(schema: dict, whole: dict | None = None, seen: tuple = ()) -> DataType:
    """The Spark type of what the schema accepts; a variant where it leaves the type open or mixed."""
    whole = whole or schema
    schema, seen = _resolved(schema, whole, seen)
    kinds = [t for t in _types(schema) if t != "null"]
    if kinds == ["object"] and schema.get("properties"):
        return StructType([StructField(k, spark_type(v, whole, seen)) for k, v in schema["properties"].items()])
    if kinds == ["array"] and "items" in schema:
        return ArrayType(spark_type(schema["items"], whole, seen))
    return _PLAIN.get(kinds[0], VariantType()) if len(kinds) == 1 else VariantType()


def _named(t: DataType) -> str:
    """The type as text, with its field names in quotes."""
    if isinstance(t, StructType):
        return "struct<" + ", ".join("`" + f.name.replace("`", "``") + "`: " + _named(f.dataType) for f in t.fields) + ">"
    return f"array<{_named(t.elementType)}>" if isinstance(t, ArrayType) else t.simpleString()


def _at(value: Column, key: str) -> Column:
    return F.try_variant_get(value, '$["' + key.replace('"', '\\"') + '"]', "variant")


def _when(broken: Column, path: str, rule: str) -> Column:
    return F.when(broken, F.array(F.lit(f"{path or '$'}:{rule}"))).otherwise(F.array().cast("array<string>"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def reasons(value: Column, schema: dict, whole: dict | None = None, path: str = "", seen: tuple = ()) -> Column:
    """Every reason (array of strings) for which the variant isn't accepted; none for a value that is missing."""
    whole = whole or schema
    schema, seen = _resolved(schema, whole, seen)
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    number = F.try_variant_get(value, "$", "double")
    is_ = lambda t: kind.isin(*_KINDS[t]) if t != "integer" else kind.isin("BIGINT") | (kind.isin(*_KINDS["number"]) & (number == F.floor(number)))
    made = []
    types = _types(schema)
    if types:
        ok = is_(types[0])
        for t in types[1:]:
            ok = ok | is_(t)
        made.append(_when(~ok, path, "type"))
    for rule, listed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if listed is not None:
            ok = F.lit(False)
            for x in listed:
                ok = ok | (is_("null") if x is None else is_("boolean") & (F.try_variant_get(value, "$", "boolean") == x) if isinstance(x, bool) else is_("string") & (_text(value) == x) if isinstance(x, str) else is_("number") & (number == float(x)))
            made.append(_when(~ok, path, rule))
    length, size = F.length(_text(value)), F.size(F.try_variant_get(value, "$", "array<variant>"))
    limits = (("minLength", "string", lambda n: length < n), ("maxLength", "string", lambda n: length > n), ("pattern", "string", lambda p: ~_text(value).rlike(p)),
              ("minimum", "number", lambda n: number < n), ("maximum", "number", lambda n: number > n), ("exclusiveMinimum", "number", lambda n: number <= n), ("exclusiveMaximum", "number", lambda n: number >= n),
              ("minItems", "array", lambda n: size < n), ("maxItems", "array", lambda n: size > n))
    for rule, of, broken in limits:
        if rule in schema:
            made.append(_when(is_(of) & broken(schema[rule]), path, rule))
    for key in schema.get("required", []):
        made.append(_when(is_("object") & _at(value, key).isNull(), f"{path}.{key}".lstrip("."), "required"))
    for key, inner in schema.get("properties", {}).items():
        made.append(reasons(_at(value, key), inner, whole, f"{path}.{key}".lstrip("."), seen))
    if schema.get("additionalProperties") is False:
        keys = F.json_object_keys(F.to_json(value))
        made.append(_when(is_("object") & (F.size(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) > 0), path, "additionalProperties"))
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: reasons(x, schema["items"], whole, f"{path}[]", seen))
        made.append(F.when(is_("array"), F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<string>")))
    if not made:
        return F.array().cast("array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.concat(*made))


def judged(docs: DataFrame, text: str, schema: dict, rules: dict[str, str] | None = None) -> DataFrame:
    """docs with sample (the typed document, null where the schema rejects it) and reasons. rules: a reason and a SQL condition over sample's fields."""
    parsed = docs.withColumn("_v", F.try_parse_json(F.col(text)))
    found = F.when(F.col("_v").isNull(), F.array(F.lit("json"))).otherwise(reasons(F.col("_v"), schema))
    # the reasons are worked out once, however often what follows names them
    made = parsed.withColumn("reasons", F.transform(F.array(F.struct(found.alias("r"))), lambda x: x["r"])[0])
    made = made.withColumn("sample", F.when(F.size("reasons") == 0, F.try_variant_get("_v", "$", _named(spark_type(schema))))).drop("_v")
    if rules:
        broken = [F.when(F.col("sample").isNotNull() & ~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in rules.items()]
        made = made.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(*broken))))
    return made


def read_documents(spark: SparkSession, path: str, schema: dict, rules: dict[str, str] | None = None) -> DataFrame:
    """file, text, sample, reasons of every JSON file below path, one document a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return judged(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), "text", schema, rules)


def accepted(made: DataFrame) -> DataFrame:
    return made.where("size(reasons) = 0").drop("reasons")


def rejected(made: DataFrame) -> DataFrame:
    return made.where("size(reasons) > 0").drop("sample")
