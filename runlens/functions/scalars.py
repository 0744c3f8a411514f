"""Column functions for payloads.

Everything here returns a ``Column`` built from JVM-side built-ins, so it
stays inside whole-stage codegen (higher-order functions excepted) and
runs wherever Spark puts the rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType,
                               StructType, VariantType)

# ---------------------------------------------------------------- fixed values
# Reference tag grammar: <head.part[.part...]>
REF_PATTERN = r"<([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)+)>"
# Environment placeholder grammar: ${NAME}
ENV_PATTERN = r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"
# Secret reference grammar (inferred from call sites): secret://NAME
SECRET_PATTERN = r"secret://([A-Za-z_][A-Za-z0-9_]*)"
# Duration text: number with optional unit ms, s, m, h, d
DURATION_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*$"
DURATION_FACTORS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
# Strict JSON path: $ followed by .name or [index] segments
JSON_PATH_PATTERN = r"^\$(?:\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*$"
JSON_PATH_TOKEN = r"\.([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]"
# Fenced block in a model answer
FENCE_PATTERN = r"(?s)```(?:json)?\s*(.*?)```"
# Hosts that count as this machine
LOOPBACK_HOSTS = ("127.0.0.1", "localhost", "::1")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------ JSON kinds

def json_kind(text: str | Column) -> Column:
    """Python-like type name of a JSON text: int, float, str, bool, list, dict, null;
    ``invalid`` when the text does not parse."""
    text = _c(text)
    t = F.schema_of_variant(F.try_parse_json(text))
    return (F.when(text.isNull(), F.lit("null"))
            .when(t.isNull(), "invalid")
            .when(t == "VOID", "null")
            .when(t == "BOOLEAN", "bool")
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
            .when(t == "STRING", "str")
            .when(t.startswith("ARRAY"), "list")
            .when(t.startswith("OBJECT"), "dict")
            .otherwise("invalid"))


def variant_kind(v: Column) -> Column:
    return let(F.schema_of_variant(v), lambda t: F.when(t.isNull(), F.lit("missing"))
               .when(t == "VOID", "null").when(t == "BOOLEAN", "bool")
               .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
               .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
               .when(t == "STRING", "str").when(t.startswith("ARRAY"), "list")
               .when(t.startswith("OBJECT"), "dict").otherwise("other"))


# ------------------------------------------------------------------ F1 json_path

def check_json_path(path: str) -> list[tuple[str, str | int]]:
    """Validate a strict path on the driver; wildcards and filters are rejected."""
    if not re.fullmatch(JSON_PATH_PATTERN, path):
        raise ValueError(f"bad JSON path {path!r}: only $.name and [index] segments are allowed")
    out: list[tuple[str, str | int]] = []
    for m in re.finditer(JSON_PATH_TOKEN, path[1:]):
        out.append(("key", m.group(1)) if m.group(1) is not None else ("index", int(m.group(2))))
    return out


def _seg_path(segs: list[tuple[str, str | int]]) -> str:
    return "$" + "".join(f"['{p}']" if k == "key" else f"[{p}]" for k, p in segs)


def json_paths(df: DataFrame, col: str, paths: dict[str, str]) -> DataFrame:
    """F1 for several paths (name -> path) over one text: it is parsed once for all of them."""
    root = "_" + "_".join(paths) + "_v"
    d = df.withColumn(root, F.try_parse_json(F.col(col)))
    for out, path in paths.items():
        d = _path_of(d, F.col(root), path, out)
    return d.drop(root)


def json_path(df: DataFrame, col: str, path: str, out: str) -> DataFrame:
    """add ``out`` = struct(value, error).  ``value`` is the JSON text of the target
    (its type kept); an unresolved path gives a null value and an error text.

    The text is parsed once; every path prefix is read from that one parsed
    value, so the expression grows linearly with the path length.
    """
    return json_paths(df, col, {out: path})


def _path_of(df: DataFrame, root: Column, path: str, out: str) -> DataFrame:
    segs = check_json_path(path)
    pcols = [f"_{out}_p{i}" for i in range(len(segs))]
    d = df.select("*", *[F.try_variant_get(root, _seg_path(segs[:i + 1]), "variant").alias(pcols[i])
                         for i in range(len(segs))])
    err = F.when(root.isNull(), F.lit(f"{path}: input is not JSON"))
    for i, (_, part) in enumerate(segs):
        # the kind of what the path stops at is looked up only where it stops
        err = err.when(F.col(pcols[i]).isNull(), F.concat(F.lit(f"{path}: cannot resolve '{part}' in "),
                                                          variant_kind(root if i == 0 else F.col(pcols[i - 1]))))
    final = F.col(pcols[-1]) if segs else root
    ecol = f"_{out}_e"
    d = d.withColumn(ecol, err)
    d = d.withColumn(out, F.struct(F.when(F.col(ecol).isNull(), F.to_json(final)).alias("value"), F.col(ecol).alias("error")))
    return d.drop(ecol, *pcols)


# ------------------------------------------------------------------ P5 dig_path

def dig_path(df: DataFrame, col: str, dotted: str, out: str) -> DataFrame:
    """P5: add ``out`` = struct(value, error) for a dotted path through maps and lists
    of a JSON text: a key part reads a map, a numeric part indexes a list."""
    parts = dotted.split(".")
    root = f"_{out}_v"
    d = df.withColumn(root, F.try_parse_json(F.col(col)))
    cur_cols = [root]
    kcols = []
    for i, part in enumerate(parts):
        prev = F.col(cur_cols[-1])
        k = f"_{out}_k{i}"
        d = d.withColumn(k, variant_kind(prev))
        nxt = F.when(F.col(k) == "dict", F.try_variant_get(prev, f"$['{part}']", "variant"))
        if part.isdigit():
            nxt = nxt.when(F.col(k) == "list", F.try_variant_get(prev, f"$[{int(part)}]", "variant"))
        name = f"_{out}_p{i}"
        d = d.withColumn(name, nxt)
        cur_cols.append(name)
        kcols.append(k)
    err = F.when(F.col(root).isNull(), F.lit(f"<{dotted}>: value is not JSON"))
    for i, part in enumerate(parts):
        k = F.col(kcols[i])
        reason = (F.when(k == "dict", F.lit(f"key '{part}' not found"))
                  .when(k == "list", F.lit(f"bad index '{part}'"))
                  .otherwise(F.concat(F.lit("cannot descend into "), k, F.lit(f" with '{part}'"))))
        err = err.when(F.col(cur_cols[i + 1]).isNull(), F.concat(F.lit(f"<{dotted}>: "), reason))
    d = d.withColumn(out, F.struct(F.when(err.isNull(), F.to_json(F.col(cur_cols[-1]))).alias("value"),
                                   err.alias("error")))
    return d.drop(*cur_cols, *kcols)


# ------------------------------------------------------------------ F2 extract_json

def with_extracted_json(df: DataFrame, col: str, out: str) -> DataFrame:
    """F2 as a DataFrame step: add ``out`` = struct(json, error).

    The fenced body and the brace span are materialised as columns, so the
    fence regex runs once per row (a fence is only searched for in texts
    that contain three backticks)."""
    t = F.col(col)
    body_c, span_c = f"_{out}_body", f"_{out}_span"
    d = df.withColumn(body_c, F.when((F.instr(t, "```") > 0) & t.rlike(FENCE_PATTERN),
                                     F.regexp_extract(t, FENCE_PATTERN, 1)).otherwise(t))
    body = F.col(body_c)
    start = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    found = (start > 0) & (F.instr(body, "}") > 0) & (last > start)
    d = d.withColumn(span_c, F.when(found, F.substring(body, start, last - start + 1)))
    span = F.col(span_c)
    err = (F.when(t.isNull(), F.lit("no text"))
           .when(span.isNull(), F.lit("no JSON object found in response"))
           .when(F.try_parse_json(span).isNull(), F.lit("invalid JSON")))
    return d.withColumn(out, F.struct(F.when(err.isNull(), span).alias("json"), err.alias("error"))) \
        .drop(body_c, span_c)


# ------------------------------------------------------------------ F3 validate_schema

# Schema type names a field may declare.
SCHEMA_TYPES = ("str", "int", "float", "bool", "list", "dict", "any")
# Texts that coerce to a boolean in lax mode.
TRUE_TEXTS = ("true", "1", "yes", "on", "t", "y")
FALSE_TEXTS = ("false", "0", "no", "off", "f", "n")


def _coerce(v: Column, typ: str, k: Column) -> tuple[Column, Column]:
    """(typed value, ok flag) for a variant field of kind ``k`` under lax coercion."""
    s = F.try_variant_get(v, "$", "string")
    if typ == "int":
        d = F.try_variant_get(v, "$", "double")
        ok = ((k == "int") | (k == "bool") | ((k == "float") & (d == F.floor(d)))
              | ((k == "str") & F.trim(s).rlike(r"^[+-]?\d+$")))
        val = F.when(k == "bool", F.try_variant_get(v, "$", "boolean").cast("long")) \
            .when(k == "str", F.trim(s).try_cast("long")).otherwise(F.try_variant_get(v, "$", "long"))
        ok = ok & val.isNotNull()   # a number that does not fit is not a valid int of this engine
        return F.when(ok, val), ok
    if typ == "float":
        ok = k.isin("int", "float", "bool") | ((k == "str") & F.trim(s).rlike(
            r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"))
        val = F.when(k == "bool", F.try_variant_get(v, "$", "boolean").cast("double")) \
            .when(k == "str", F.trim(s).try_cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        return F.when(ok, val), ok
    if typ == "bool":
        low = F.lower(F.trim(s))
        ok = (k == "bool") | ((k == "int") & s.isin("0", "1")) | ((k == "str") & low.isin(*TRUE_TEXTS, *FALSE_TEXTS))
        val = F.when(k == "bool", F.try_variant_get(v, "$", "boolean")) \
            .when(k == "int", s == "1").otherwise(low.isin(*TRUE_TEXTS))
        return F.when(ok, val), ok
    if typ == "str":
        ok = k == "str"
        return F.when(ok, s), ok
    if typ == "list":
        ok = k == "list"
        return F.when(ok, F.to_json(v)), ok
    if typ == "dict":
        ok = k == "dict"
        return F.when(ok, F.to_json(v)), ok
    ok = k != "missing"
    return F.when(ok, F.to_json(v)), ok


def validate_schema(df: DataFrame, col: str, schema: dict[str, str], out: str,
                    raw: str | None = None) -> DataFrame:
    """add ``out`` = struct(valid, error, <field>...) for required typed fields under
    lax coercion.  The JSON is parsed once and each field read once (materialised
    columns), so the row expression stays small.

    With ``raw`` the text of that column comes along under ``text`` in valid rows, unless the
    schema declares a field of that name.
    An unknown type name is an error at once (on the driver), as in the reference.
    """
    for name, typ in schema.items():
        if typ not in SCHEMA_TYPES:
            raise ValueError(f"output_schema: unknown type '{typ}' (have: {', '.join(SCHEMA_TYPES)})")
    root = f"_{out}_v"
    d = df.withColumn(root, F.try_parse_json(F.col(col)))
    names = list(schema)
    d = d.select("*", *[F.try_variant_get(F.col(root), f"$['{n}']", "variant").alias(f"_{out}_f{i}")
                        for i, n in enumerate(names)])
    fields, errs, tmp = [], [], [root]
    for i, (name, typ) in enumerate(schema.items()):
        fv = F.col(f"_{out}_f{i}")
        kc = f"_{out}_k{i}"
        d = d.withColumn(kc, variant_kind(fv))
        val, ok = _coerce(fv, typ, F.col(kc))
        okc, valc = f"_{out}_ok{i}", f"_{out}_val{i}"
        d = d.withColumn(okc, ok).withColumn(valc, val)
        tmp += [f"_{out}_f{i}", kc, okc, valc]
        fields.append(F.col(valc).alias(name))
        errs.append(F.when(fv.isNull(), F.lit(f"{name}: field required"))
                    .when(~F.col(okc), F.lit(f"{name}: not a valid {typ}")))
    err = F.when(F.col(root).isNull(), F.lit("not JSON")).otherwise(F.concat_ws("; ", *errs))
    err = F.when(err == "", F.lit(None)).otherwise(err)
    if raw is not None and "text" not in schema:
        fields.append(F.when(err.isNull(), F.col(raw)).alias("text"))
    d = d.withColumn(out, F.struct(err.isNull().alias("valid"), err.alias("error"), *fields))
    return d.drop(*tmp)


# ------------------------------------------------------------------ F5 .. F22

def estimate_tokens(text: str | Column) -> Column:
    """max(1, chars div 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4).cast("long"))


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII written as \\u escapes (two for those beyond 16 bits)."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.lit(0xD800) + F.floor((code - 0x10000) / 1024), F.lit(0xDC00) + (code - 0x10000) % 1024
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(t, ""), escape), ""))
               .otherwise(t))


# digits before the point, digits after it, exponent
_FLOAT_PARTS = r"^([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def float_text(x: Column) -> Column:
    """A double as Python writes it: the shortest digits that read back as the same number, with ``.0`` for whole
    numbers, an exponent below 1e-04 and from 1e+16, and NaN, Infinity, -Infinity as ``json.dumps`` has them.

    Every step is bound once (``let``), so the expression grows with the steps and not with their product."""
    def shortest(size: Column, places: Sequence[int]) -> list[Column]:
        return [let(F.format_string(f"%.{p}e", size), lambda t: F.when(t.try_cast("double") == size, t)) for p in places]

    def digits_of(size: Column) -> Column:
        # 15 digits hold any shorter text that reads back; numbers near zero have fewer digits than that
        return F.when(size < 2.3e-308, F.coalesce(*shortest(size, range(17)))) \
            .otherwise(F.coalesce(*shortest(size, (14, 15, 16)), size.cast("string")))

    def parts_of(text: Column) -> Column:
        whole = F.regexp_extract(text, _FLOAT_PARTS, 1)
        power = F.coalesce(F.regexp_extract(text, _FLOAT_PARTS, 3).try_cast("int"), F.lit(0))
        return F.struct(F.concat(whole, F.regexp_extract(text, _FLOAT_PARTS, 2)).alias("both"),
                        (power + F.length(whole) - 1).alias("first"))

    def counted(p: Column) -> Column:
        # the digits that count, and the decimal exponent of the first of them
        lead = F.length(p["both"]) - F.length(F.regexp_replace(p["both"], r"^0+", ""))
        return F.struct(F.regexp_replace(p["both"], r"^0+|0+$", "").alias("digits"), (p["first"] - lead).alias("e"))

    def written(p: Column) -> Column:
        digits, e = p["digits"], p["e"]
        n = F.length(digits)
        fixed = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)) \
            .when(n <= e + 1, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))) \
            .otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n)))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
        sci = F.concat(F.substring(digits, 1, 1), tail, F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")),
                       F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")))
        return F.when((e < -4) | (e >= 16), sci).otherwise(fixed)

    def signed(x: Column) -> Column:
        sign = F.when(F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        number = F.when(x == 0, F.lit("0.0")).otherwise(
            let(F.abs(x), lambda size: let(digits_of(size), lambda t: let(parts_of(t), lambda p: let(counted(p), written)))))
        # a null must not reach the texts: each try to read one back would raise inside the cast
        return F.when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))) \
            .when(x.isNotNull(), F.concat(sign, number))
    return let(x, signed)


def _json_string(text: Column) -> Column:
    """A JSON string, quotes included, ASCII only."""
    return ascii_json(let(F.to_json(F.array(text)), lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2)))


def canonical_text(value: Column, dtype: DataType) -> Column:
    """Canonical JSON text of a value of the given type: keys of structs and maps sorted at every level, no spaces, nulls
    kept, ASCII only.  Equals Python's ``json.dumps(sort_keys=True, separators=(',', ':'))`` for texts, whole
    numbers, floats, booleans, nulls, lists and maps; other types count as their text."""
    if isinstance(dtype, StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_text(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(dtype, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_text(x, dtype.elementType)), ","), F.lit("]"))
    elif isinstance(dtype, MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(
            e["key"].cast("string").alias("k"), canonical_text(e["value"], dtype.valueType).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(
            entries, lambda e: F.concat(_json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(dtype, (DoubleType, FloatType)):
        text = float_text(value.cast("double"))
    elif isinstance(dtype, (BooleanType, IntegralType)):
        text = value.cast("string")
    elif isinstance(dtype, NullType):
        return F.lit("null")
    elif isinstance(dtype, VariantType):
        text = ascii_json(F.to_json(value))
    else:
        text = _json_string(value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def canonical_json(df: DataFrame, value: Column) -> Column:
    """Canonical JSON text of a column expression over ``df``, whose types it takes from there."""
    return canonical_text(value, df.select(value.alias("v")).schema["v"].dataType)


def canonical_hash(df: DataFrame, node_type: str | Column, config: dict[str, Column], item: Column) -> Column:
    """SHA-256 hex of the canonical JSON of {config, item, type}."""
    nt = F.lit(node_type) if isinstance(node_type, str) else node_type
    packed = F.struct(*[c.alias(k) for k, c in config.items()]) if config else F.create_map().cast("map<string,string>")
    return F.sha2(canonical_json(df, F.struct(nt.alias("type"), packed.alias("config"), item.alias("item"))), 256)


def parse_duration(text: str | Column) -> Column:
    """struct(seconds, error) for '500ms', '20s', '15m', '1h', '1d' or a plain number."""
    t = _c(text)
    ok = t.rlike(DURATION_PATTERN)
    num = F.regexp_extract(t, DURATION_PATTERN, 1).try_cast("double")
    unit = F.regexp_extract(t, DURATION_PATTERN, 2)
    factor = F.lit(1.0)
    for u, f in DURATION_FACTORS.items():
        factor = F.when(unit == u, F.lit(f)).otherwise(factor)
    return F.struct(F.when(ok, num * factor).alias("seconds"),
                    F.when(~ok | t.isNull(), F.concat(F.lit("bad duration "), F.coalesce(t, F.lit("null"))))
                     .alias("error"))


def typed_literal(text: str | Column) -> Column:
    """struct(key, raw, type): ``key=value`` split on the first ``=``; the value is
    JSON when it parses (type tag of the JSON value), else plain text (tag ``text``)."""
    t = _c(text)
    pos = F.instr(t, "=")
    key = F.when(pos > 0, F.substring(t, F.lit(1), pos - 1))
    raw = F.when(pos > 0, F.substring(t, pos + 1, 1 << 30))
    kind = json_kind(raw)
    tag = F.when(raw.isNull(), F.lit(None)).when(kind == "invalid", "text").otherwise(kind)
    return F.struct(key.alias("key"), raw.alias("raw"), tag.alias("type"),
                    F.when(pos == 0, F.lit("expects key=value")).alias("error"))


def slugify(text: str | Column) -> Column:
    """first four lowercase alphanumeric runs joined by '_', default 'workflow'."""
    # one match from the start holds the first four runs, however long the text is
    head = F.regexp_extract(F.lower(_c(text)), "^[^a-z0-9]*+((?:[a-z0-9]++[^a-z0-9]*+){0,4})", 1)
    s = F.regexp_replace(F.regexp_replace(head, "[^a-z0-9]+", "_"), "_$", "")
    return F.when((s == "") | s.isNull(), F.lit("workflow")).otherwise(s)


def normalize_url(url: str | Column, kind: str = "openai") -> Column:
    """struct(origin, host, port, alias, error) from a bare host, host:port or full URL.

    The path is dropped; a missing port is 443 for https and 80 otherwise;
    the alias uses ``local`` for loopback hosts and ``_`` for dots.  A port beyond 65535
    gives an error and no origin, port or alias.
    """
    raw = F.trim(_c(url))
    raw = F.when(F.instr(raw, "://") > 0, raw).otherwise(F.concat(F.lit("http://"), raw))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    scheme = F.when(scheme == "", F.lit("http")).otherwise(scheme)
    netloc = F.regexp_extract(raw, r"://([^/?#]*)", 1)
    hostport = F.regexp_extract(netloc, r"([^@]*)$", 1)
    v6 = F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)
    host = F.when(v6 != "", v6).otherwise(F.regexp_extract(hostport, r"^([^:]*)", 1))
    host = F.lower(host)
    host = F.when(host == "", F.lit("localhost")).otherwise(host)
    port_txt = F.when(v6 != "", F.regexp_extract(hostport, r"^\[[^\]]*\]:(\d+)$", 1)) \
        .otherwise(F.regexp_extract(hostport, r":(\d+)$", 1))
    explicit = F.when(port_txt != "", port_txt.try_cast("int"))
    bad = (port_txt != "") & (explicit.isNull() | (explicit > 65535))
    port = F.coalesce(explicit, F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80)))
    netloc_out = F.when(explicit.isNotNull(), F.concat(host, F.lit(":"), explicit.cast("string"))).otherwise(host)
    prefix = "ollama" if kind == "ollama" else "openai"
    alias = F.when(host.isin(*LOOPBACK_HOSTS), F.concat(F.lit(f"{prefix}_local_"), port.cast("string"))) \
        .otherwise(F.concat(F.lit(f"{prefix}_"), F.translate(host, ".", "_"), F.lit("_"), port.cast("string")))
    return F.struct(F.when(~bad, F.concat(scheme, F.lit("://"), netloc_out)).alias("origin"), host.alias("host"),
                    F.when(~bad, port).alias("port"), F.when(~bad, alias).alias("alias"),
                    F.when(bad, F.concat(F.lit("bad port "), port_txt)).alias("error"))


def parse_ts(text: str | Column) -> Column:
    """ISO text to timestamp; null when it does not parse."""
    return F.try_to_timestamp(_c(text))


def refs_in(text: str | Column) -> Column:
    """P6 for one text: distinct placeholders, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(REF_PATTERN), 1))


def env_names(text: str | Column) -> Column:
    """distinct ${NAME} names in a text."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(ENV_PATTERN), 1))


def secret_names(text: str | Column) -> Column:
    """distinct secret://NAME names in a text."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(SECRET_PATTERN), 1))


def fill_once(template: Column, pattern: str, open_: str, close: str, values: Column) -> Column:
    """Replace every placeholder of ``template`` that ``values`` (map name -> text) holds, in one pass.

    The template is cut once into literals and names and put together again,
    so a value that looks like a placeholder stays as it is.
    """
    # the number of literals is one more than that of names
    literals = F.split(template, pattern, -1)
    names = F.regexp_extract_all(template, F.lit(pattern), 1)

    def piece(literal: Column, name: Column) -> Column:
        kept = F.concat(F.lit(open_), name, F.lit(close))
        return F.concat(literal, F.when(name.isNull(), F.lit("")).otherwise(
            F.coalesce(F.try_element_at(values, name), kept)))
    return F.array_join(F.zip_with(literals, names, piece), "")


def interpolate(template: str | Column, bindings: dict[str, Column]) -> Column:
    """struct(text, value, value_type, unresolved).

    ``text``: every ``<ref>`` with a binding replaced by the value as text, in one pass.
    ``value``: for a template that is exactly one ref, the bound value as JSON
    text, so that its type is kept, and in ``value_type`` the name of that type.
    ``unresolved``: refs without a binding (an error in the reference).
    """
    t = _c(template)
    pairs = [x for name, col in bindings.items() for x in (F.lit(name), F.coalesce(col.cast("string"), F.lit("None")))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    single = F.regexp_extract(F.trim(t), f"^{REF_PATTERN}$", 1)
    value, kind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, col in bindings.items():
        # a one-field object keeps the JSON form of the value, whatever its type
        json = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
        value = value.when(single == name, F.substring(json, F.lit(6), F.length(json) - 6))
        kind = kind.when(single == name, F.typeof(col))
    left = F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(REF_PATTERN), 1),
                                     lambda r: ~r.isin(*bindings) if bindings else F.lit(True)))
    return F.struct(fill_once(t, REF_PATTERN, "<", ">", values).alias("text"), value.alias("value"),
                    kind.alias("value_type"), left.alias("unresolved"))


def summarize_text(text: str | Column, limit: int = 200) -> Column:
    """P7 for text: cut with '… (+n chars)' when longer than ``limit``."""
    t = _c(text)
    n = F.length(t)
    return F.when(n > limit, F.concat(F.substring(t, 1, limit), F.lit("… (+"),
                                      (n - limit).cast("string"), F.lit(" chars)"))).otherwise(t)


def summarize_list(arr: str | Column, limit: int = 10) -> Column:
    """P7 for a list of text: first ``limit`` items then '… (+n items)'."""
    a = _c(arr)
    n = F.size(a)
    return F.when(n > limit, F.concat(F.slice(a, 1, limit), F.array(F.concat(
        F.lit("… (+"), (n - limit).cast("string"), F.lit(" items)"))))).otherwise(a)


def summarize_map(m: str | Column, limit: int = 200) -> Column:
    """P7 for a map of text: values summarised (maps recurse, lists do not)."""
    return F.transform_values(_c(m), lambda k, v: summarize_text(v, limit))


def falsy(c: Column, kind: str) -> Column:
    """Python truthiness inverted: null, '', 0, false, empty list/map."""
    if kind == "str":
        return c.isNull() | (c == "")
    if kind == "num":
        return c.isNull() | (c == 0)
    if kind == "bool":
        return c.isNull() | ~c
    if kind in ("list", "map"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def missing_fields(values: dict[str, tuple[Column, str]],
                   spec: Sequence[tuple[str, bool, object]]) -> tuple[Column, dict[str, Column]]:
    """P10: (names, filled): names of required fields that are falsy and have no default, in spec order, and every
    field with its default in place of a falsy value."""
    names = [F.when(falsy(values[n][0], values[n][1]), F.lit(n)) for n, req, default in spec
             if req and default is None]
    filled = {n: values[n][0] if default is None else F.when(falsy(*values[n]), F.lit(default)).otherwise(values[n][0])
              for n, _, default in spec}
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"), filled


def text_of(value: str | Column, limit: int = 8000, is_text: bool = True) -> Column:
    """a value as text (JSON when it is not text), cut to ``limit`` characters."""
    v = _c(value)
    t = v if is_text else F.to_json(v)
    return F.substring(t, 1, limit)


def keyed_map_to_list(m: str | Column, id_field: str = "id") -> Column:
    """F16: map keyed by id -> list of structs carrying the id (value struct fields follow)."""
    return F.transform(F.map_entries(_c(m)), lambda e: F.struct(e["key"].alias(id_field), e["value"].alias("spec")))


def text_to_list(text: str | Column) -> Column:
    """F16 for a bare text: a one-element list."""
    t = _c(text)
    return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array(t))


def words(text: str | Column) -> Column:
    """Whitespace split of a whole text (empty text gives no words)."""
    return let(F.regexp_replace(_c(text), r"^\s+|\s+$", ""),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+")))


# ------------------------------------------------------------------ F13 Python semantics

def floordiv(a: Column, b: Column, kind: str = "int") -> Column:
    """``a // b``: floor of the quotient; null for a zero divisor (an error in Python).

    ``kind='int'`` divides whole numbers exactly; the one quotient beyond 64 bits, the smallest number
    over -1, is null.  ``'float'`` stays in doubles, of any size, and divides as Python does:
    what the remainder leaves is divided, so that 1.0 // 0.1 is 9.0.
    """
    if kind == "float":
        a, b = a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))
        rest = a % b
        q = (a - rest) / b - F.when((rest != 0) & ((b < 0) != (rest < 0)), 1.0).otherwise(0.0)
        whole = F.when(F.abs(q) < float(1 << 52), F.floor(q).cast("double")).otherwise(q)
        return F.when(q - whole > 0.5, whole + 1.0).otherwise(whole)
    b = F.nullif(b, F.lit(0))
    by = F.when(b != -1, b)
    down = (a % by != 0) & ((a % by < 0) != (by < 0))
    return F.coalesce(F.call_function("div", a, by) - F.when(down, 1).otherwise(0), F.when(b == -1, F.try_subtract(F.lit(0), a)))


def pymod(a: Column, b: Column) -> Column:
    """``a % b`` with the sign of the divisor; null for a zero divisor."""
    r = a % F.nullif(b, F.lit(0))
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def round_even(a: Column, digits: int = 0) -> Column:
    """``round(a, n)``: half to even."""
    return F.bround(a, digits)


def truthy_str(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def truthy_num(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def py_len(c: Column, kind: str = "str") -> Column:
    return F.length(c) if kind == "str" else F.size(c)


def py_in(needle: Column, hay: Column, kind: str = "str") -> Column:
    return F.contains(hay, needle) if kind == "str" else F.array_contains(hay, needle)
