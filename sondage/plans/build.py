"""Version-dispatched build of flat survey tables.

Plan shape
----------
1. Scan the raw store with the survey, time and version predicates pushed
   down (O01, O04, O13).
2. The payload keys of each (survey, version) come from the key catalog kept at
   ingest; the same scan checks that no payload holds a key the catalog lacks.
   Without a catalog one aggregate discovers them (``distinct`` over
   ``json_object_keys(data)``, combined in each task).  Their number is the
   survey *schema*, not the data, and has a declared limit.
3. The payload is parsed once, into a struct holding only the needed keys.
   Rows that do not decode are left out here, before a copy is chosen, so a
   truncated copy never displaces a whole one; ``build_rejects`` reports them.
4. In-batch de-duplication on ``(survey, id)`` (O31 'ignore' semantics): one lazy
   exchange on the key, each task keeping one row per key.
5. For every (survey, version) member the processor chain (O44) runs on column
   *metadata*: casts append an operation to a column, renames change its name.
   The results are merged into ONE projection: each output column is
   ``coalesce`` of the payload fields that feed it (a row only carries the keys
   of its own member, and the per-member collision check guarantees one source
   per row), guarded by a member predicate only where one raw key is treated
   differently by different members.  A custom processor is a DataFrame
   function; the chain is compiled up to it, the function gets the rows of its
   versions, and the rest of the chain goes on with the columns it returns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import evaluate_once, schema_rows
from ..functions.cast import CAST_TYPES, RESULT_TYPES, cast_expr, widest
from ..functions.rename import (DEFAULT_SEPARATOR, RenameChain, default_chain, parse_rename_rules)
from ..functions.select import ColumnSelector
from ..functions.versions import VersionSelector, canonical, parse_selector, parse_version, version_array
from ..sources.raw import STRICT, one_value, time_range_filter

# --- fixed values ----------------------------------------------------------------------------
POSITIONS = ["before_casting", "default_casting", "after_casting", "default_renaming", "end"]
CUSTOM_DEFAULT_POSITION = "after_casting"
# Standard fields after default renaming, in output order.
STANDARD_FIELDS = ["id", "global_id", "version", "timestamp", "opened", "language", "engineVersion"]
# Question type -> column type when the schema is inferred from survey info.
QUESTION_TYPE_MAP = {"multiple": "bool", "date": "date", "unknown": "json"}
# Standard payload fields that are always instants.
ALWAYS_DATES = ["submitted", "opened"]
# ---------------------------------------------------------------------------------------------

BAD_FIELD = "__sondage_corrupt__"  # corrupt-record column of the payload parse
#: Columns that tell a row's member to custom processors and to what follows them.
MEMBER_SURVEY, MEMBER_VERSION = "__survey", "__version"
#: Types of a column that gets several: numbers widen; text is read as the other type; else text.
NUMBERS = {"bigint", "double"}


@dataclass(frozen=True)
class ColumnSpec:
    """Where an output column comes from: a source column, its type, and the casts applied to it."""

    key: str
    ops: tuple = ()
    base: str = "string"  # type of the source column
    number: str | None = None  # 'int' or 'float': the key's values are all such JSON numbers

    @property
    def result_type(self) -> str:
        op = self.ops[-1] if self.ops else self.number
        return RESULT_TYPES[op] if op else self.base

    def with_op(self, op: str) -> "ColumnSpec":
        if self.result_type == RESULT_TYPES[op] and op != "json":
            return self  # already of that type: the reference skips it too
        return ColumnSpec(self.key, self.ops + (op,), self.base)

    def expr(self, source: Column, on_error: str) -> Column:
        for op in self.ops or ((self.number,) if self.number else ()):
            source = cast_expr(source, op, on_error)
        return source


Plan = dict  # current column name -> ColumnSpec, in insertion order


# --- processors (metadata transforms) -----------------------------------------------------------


@dataclass
class Processor:
    name: str
    position: str = CUSTOM_DEFAULT_POSITION
    version: VersionSelector | None = None

    def applies_to(self, version: str) -> bool:
        return self.version is None or self.version.is_empty or self.version.matches(version)

    def plan(self, cols: Plan, survey: str | None) -> Plan:
        raise NotImplementedError


@dataclass
class SchemaCast(Processor):
    """O27 in the chain: the casts of the column-type map; ``text`` keeps numbers as text."""

    column_types: Mapping | Callable | None = None

    inferred: Mapping | None = None  # {survey: {column: type}} from survey info

    def types_for(self, survey: str | None) -> Mapping[str, str]:
        """Precedence: inferred from survey info < built-in (instants) < profile."""
        ct = self.column_types
        profile = {} if ct is None else (ct(survey) if callable(ct) else ct)
        inferred = dict((self.inferred or {}).get(survey, {}))
        inferred.update({c: "date" for c in ALWAYS_DATES})
        inferred.update(profile)
        return inferred

    def plan(self, cols: Plan, survey: str | None) -> Plan:
        types = self.types_for(survey)
        out = {}
        for name, spec in cols.items():
            t = types.get(name)
            out[name] = spec.with_op(t) if t in CAST_TYPES else ColumnSpec(spec.key, spec.ops, spec.base) if t == "text" else spec
        return out


@dataclass
class RuleCast(Processor):
    """O28 in the chain: ``to_bool``/``to_date`` on selected columns."""

    kind: str = "bool"
    selector: ColumnSelector | None = None

    def plan(self, cols: Plan, survey: str | None) -> Plan:
        chosen = set(self.selector.select(list(cols))) if self.selector else set()
        return {n: (s.with_op(self.kind) if n in chosen else s) for n, s in cols.items()}


@dataclass
class Rename(Processor):
    """O16/O17 in the chain: a rename chain with the collision check."""

    chain: RenameChain | None = None

    def plan(self, cols: Plan, survey: str | None) -> Plan:
        mapping = self.chain.plan(list(cols))
        return {mapping[n]: s for n, s in cols.items()}


@dataclass
class Custom(Processor):
    """A user function ``DataFrame -> DataFrame`` at its position, for the rows of its versions.

    It sees the columns as they are there (raw keys before the renaming, which
    must differ in more than case), and ``__survey`` and ``__version``, which it
    must keep.  Rows of other versions
    pass through unchanged; columns it adds are null for them.
    """

    fn: Callable[[DataFrame], DataFrame] | None = None

    def run(self, df: DataFrame) -> DataFrame:
        if self.version is None or self.version.is_empty:
            return self.fn(df)
        mine = self.version.column(F.col(MEMBER_VERSION))
        return self.fn(df.where(mine)).unionByName(df.where(~mine), allowMissingColumns=True)


# --- profile --------------------------------------------------------------------------------------


@dataclass
class BuildProfile:
    separator: str = DEFAULT_SEPARATOR
    versions: VersionSelector = field(default_factory=VersionSelector)
    column_types: Mapping | Callable | None = None
    processors: list = field(default_factory=list)
    start_time: object = None
    end_time: object = None
    mode: str = "ignore"
    dedupe: bool = True  # False: the raw store is keyed already
    on_error: str = "error"
    keys: Mapping | None = None  # {(survey, version): [keys]} when the schema is known
    verify_keys: bool = True  # whether given keys are checked against every payload
    numbers: Mapping = field(default_factory=dict)  # {key: 'int' | 'float'} with given keys
    infer_numbers: bool = True  # whether keys whose values are all JSON numbers become int/float columns
    compressor: str | None = None  # payload codec of the raw store (None/'none', 'zlib' or 'zstd')

    def chain_for(self, version: str) -> list:
        return [p for p in self.processors if p.applies_to(version)]


def _position_rank(p: Processor) -> int:
    if p.position not in POSITIONS:
        raise ValueError(f"unknown processor position {p.position!r}; expected one of {POSITIONS}")
    return POSITIONS.index(p.position)


def order_processors(processors: Sequence[Processor]) -> list[Processor]:
    """Stable sort by position."""
    return sorted(processors, key=_position_rank)


def parse_processor(spec: Mapping | str, separator: str, defaults: Mapping[str, Processor] | None = None) -> Processor:
    """A processor definition, or the name of a default one."""
    if isinstance(spec, str):
        if spec not in (defaults or {}):
            raise ValueError(f"unknown default processor {spec!r}")
        return defaults[spec]
    name = spec["name"]
    position = spec.get("position", CUSTOM_DEFAULT_POSITION)
    version = parse_selector(spec["version"]) if spec.get("version") else None
    if name in ("to_bool", "to_date"):
        return RuleCast(name, position, version, kind=name[3:], selector=ColumnSelector(spec["columns"]))
    if name == "rename":
        if not isinstance(spec.get("rules"), list):
            raise ValueError("processor 'rename' needs a 'rules' list")
        chain = RenameChain(parse_rename_rules(spec["rules"], separator), excluded=spec.get("excluded") or ())
        return Rename(name, position, version, chain=chain)
    if name == "custom":
        return Custom(name, position, version, fn=spec["fn"])
    raise ValueError(f"unknown processor {name!r}")


def parse_profile(spec: Mapping) -> BuildProfile:
    """A build profile in the reference vocabulary (plain dict)."""
    sep = spec.get("key_separator", DEFAULT_SEPARATOR)
    defaults = {
        "default_casting": SchemaCast("default_casting", "default_casting", None,
                                      column_types=spec.get("schema"), inferred=spec.get("inferred_schema")),
        "default_renaming": Rename("default_renaming", "default_renaming", None, chain=default_chain(sep))}
    given = list(spec.get("processors") or [])
    if spec.get("processors_defaults", True):
        given += list(defaults)
    procs = [p if isinstance(p, Processor) else parse_processor(p, sep, defaults) for p in given]
    return BuildProfile(
        separator=sep,
        versions=parse_selector(spec.get("versions")),
        column_types=spec.get("schema"),
        processors=order_processors(procs),
        start_time=spec.get("start_time"),
        end_time=spec.get("end_time"),
        mode=spec.get("mode", "ignore"),
        dedupe=bool(spec.get("dedupe", True)),
        on_error=spec.get("on_error", "error"),
        keys=spec.get("keys"),
        verify_keys=spec.get("verify_keys", True),
        numbers=spec.get("numbers") or {},
        infer_numbers=spec.get("infer_numbers", True),
        compressor=spec.get("compressor"),
    )


# --- dispatch --------------------------------------------------------------------------------------


def run_processors(plans: Mapping[tuple, Plan], processors: Sequence[Processor]) -> dict[tuple, Plan]:
    """Run a stretch of the chain over each member's columns (driver-side, names and types only)."""
    out = {}
    for (survey, version), cols in plans.items():
        for proc in processors:
            if proc.applies_to(version):
                try:
                    cols = proc.plan(cols, survey)
                except ValueError as e:
                    raise type(e)(f"survey {survey!r} version {version!r}: {e}") from e
        out[(survey, version)] = cols
    return out


def member_plans(members: Mapping[tuple, Sequence[str]], profile: BuildProfile,
                 numbers: Mapping[str, str] | None = None) -> dict[tuple, Plan]:
    """Each member's columns after its whole chain, custom functions left out."""
    return run_processors(_payload_plans(members, numbers), [p for p in profile.processors if not isinstance(p, Custom)])


def _payload_plans(members: Mapping[tuple, Sequence[str]], numbers: Mapping[str, str] | None) -> dict[tuple, Plan]:
    for _, version in members:
        parse_version(version)  # a malformed version is an error, as in the reference
    return {m: {k: ColumnSpec(k, number=(numbers or {}).get(k)) for k in sorted(keys)} for m, keys in members.items()}


def _member_key(survey_col: Column, version_col: Column) -> Column:
    return F.concat_ws("\u0001", F.coalesce(survey_col, F.lit("")), version_col)


def _member_lit(survey, version) -> str:
    return f"{survey or ''}\u0001{version}"


def _common_type(types: set[str]) -> str:
    """The type of a column that its members give several types."""
    if types <= NUMBERS:
        return "double" if len(types) > 1 else next(iter(types))
    typed = types - {"string"}
    return typed.pop() if len(typed) == 1 else "string"


def compile_projection(plans: Mapping[tuple, Plan], lookup: Callable[[str], Column], survey_col: Column,
                       version_col: Column, on_error: str = "error") -> dict[str, Column]:
    """Merge per-member plans into one expression per output column.

    A column that only some versions cast gets the cast type; the text of the
    other versions is read as that type, null where it is no such value.
    Keys with the same casts are coalesced first, so a value is cast once
    however many surveys there are.
    """
    # raw key -> {(target, spec)} over the members that contain it
    by_key: dict[str, set] = {}
    # target -> {spec -> [members]}
    by_target: dict[str, dict] = {}
    for member, cols in plans.items():
        for target, spec in cols.items():
            by_key.setdefault(spec.key, set()).add((target, spec))
            by_target.setdefault(target, {}).setdefault(spec, []).append(member)
    mkey = _member_key(survey_col, version_col)
    exprs: dict[str, Column] = {}
    for target, sources in by_target.items():
        rtype = _common_type({s.result_type for s in sources})
        reader = next((op for op, t in RESULT_TYPES.items() if t == rtype and t != "string"), None)
        alike: dict[ColumnSpec, list[Column]] = {}  # the casts -> the sources they apply to
        for spec, members in sorted(sources.items(), key=lambda kv: (kv[0].key, kv[0].ops)):
            e = lookup(spec.key)
            if len(by_key[spec.key]) > 1:  # same key treated differently elsewhere: guard it
                e = F.when(mkey.isin(*[_member_lit(*m) for m in members]), e)
            alike.setdefault(replace(spec, key=""), []).append(e)
        terms = []
        for spec, found in alike.items():
            e = spec.expr(found[0] if len(found) == 1 else F.coalesce(*found), on_error)
            if spec.result_type == "string" and reader:
                e = cast_expr(e, reader, "null")
            terms.append(e.cast(rtype))
        exprs[target] = terms[0] if len(terms) == 1 else F.coalesce(*terms)
    return exprs


def _uses_json(plans: Mapping[tuple, Plan], target: str) -> bool:
    return any("json" in plan[target].ops for plan in plans.values() if target in plan)


def output_order(names: Sequence[str]) -> list[str]:
    std = [c for c in STANDARD_FIELDS if c in names]
    rest = sorted(c for c in names if c not in STANDARD_FIELDS)
    return std + rest


def discover_schema(raw: DataFrame, data_col: str = "data", survey_col: str = "survey",
                    numbers: bool = True) -> tuple[dict[tuple, list[str]], dict[str, str]]:
    """Payload keys of each (survey, version), and the keys whose values are all JSON numbers (``int``/``float``)."""
    members, kinds = discover_kinds(raw, data_col, survey_col, numbers)
    return members, {k: x for k, x in kinds.items() if x in ("int", "float")}


def discover_kinds(raw: DataFrame, data_col: str = "data", survey_col: str = "survey",
                   numbers: bool = True) -> tuple[dict[tuple, list[str]], dict[str, str]]:
    """Payload keys of each (survey, version), and the widest kind of each key's values (``KINDS``; else text).

    One aggregate of distinct (survey, version, key, kind of value), combined in
    each task.  Payloads that do not decode have no keys.
    """
    s = F.col(survey_col) if survey_col in raw.columns else F.lit(None).cast("string")
    if numbers:
        entry = F.from_json(one_value(F.col(data_col)), "map<string,variant>", STRICT)
        rows = raw.select(s.alias("s"), F.col("version").alias("v"), F.explode(entry).alias("k", "x"))
        kind = F.substring(F.schema_of_variant("x"), 1, 6)  # a handful; named at the driver, as each test of it here would work it out again
    else:
        keys = F.explode(F.json_object_keys(F.col(data_col).cast("string")))
        rows, kind = raw.select(s.alias("s"), F.col("version").alias("v"), keys.alias("k")), F.lit("STRING")
    got = schema_rows(rows.select("s", "v", "k", kind.alias("kind")).distinct(), "set of payload keys")
    members: dict[tuple, set] = {}
    kinds: dict[str, set] = {}
    for r in got:
        members.setdefault((r["s"], r["v"]), set()).add(r["k"])
        kinds.setdefault(r["k"], set()).add({"BIGINT": "int", "DECIMA": "float", "DOUBLE": "float", "VOID": "null"}.get(r["kind"], "text"))
    return {m: sorted(k) for m, k in members.items()}, {k: widest(x) for k, x in kinds.items()}


def discover_members(raw: DataFrame, survey_col: str = "survey", data_col: str = "data") -> dict[tuple, list[str]]:
    """(survey, version) -> sorted payload keys; one small aggregate job."""
    return discover_schema(raw, data_col, survey_col, numbers=False)[0]


def keys_listed(data: Column, keys: Mapping[tuple, Sequence[str]], survey_col: Column, version_col: Column) -> Column:
    """True; an error where a payload holds a key that ``keys`` does not list for its (survey, version)."""
    pairs = [x for m, ks in keys.items() for x in (F.lit(_member_lit(*m)), F.array(*[F.lit(k) for k in ks]).cast("array<string>"))]
    listed = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    known = F.coalesce(F.try_element_at(listed, _member_key(survey_col, version_col)), F.array().cast("array<string>"))
    extra = F.array_except(F.json_object_keys(data.cast("string")), known)
    where = F.concat_ws(" ", F.coalesce(survey_col, F.lit("")), version_col)
    return F.when(F.coalesce(F.size(extra), F.lit(0)) <= 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("payload keys missing from the key catalog, "), where, F.lit(": "), F.array_join(extra, ", "))).cast("boolean"))


def payload_struct(keys: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in keys]
                        + [T.StructField(BAD_FIELD, T.StringType())])


def positional_name(i: int) -> str:
    return f"k{i}"


def decode_struct(data: Column, keys: Sequence[str]) -> Column:
    """Parse the payload into a struct of just ``keys`` (text; nested objects stay JSON text).

    The parser matches keys exactly; the struct is then cast to positional
    field names (``k0..kN``, the corrupt-record flag last), so keys that differ
    only in case never make a field reference ambiguous.
    """
    parsed = F.from_json(one_value(data), payload_struct(keys), {"columnNameOfCorruptRecord": BAD_FIELD, **STRICT})
    positional = T.StructType([T.StructField(positional_name(i), T.StringType()) for i in range(len(keys))]
                              + [T.StructField(BAD_FIELD, T.StringType())])
    return parsed.cast(positional)


def payload_ok(p: Column) -> Column:
    """The payload parsed as a JSON object (malformed text, arrays, scalars and null fail)."""
    return p.isNotNull() & p.getField(BAD_FIELD).isNull()


def prepare_raw(raw: DataFrame, profile: BuildProfile, survey: str | None = None) -> DataFrame:
    """Survey, time and version predicates on the raw rows (all pushed before decode)."""
    df = raw
    if survey is not None and "survey" in df.columns:
        df = df.where(F.col("survey") == F.lit(survey))
    df = time_range_filter(df, profile.start_time, profile.end_time)
    if not profile.versions.is_empty:
        df = df.where(profile.versions.column(F.col("version")))
    return df


def _scanned(raw: DataFrame, prof: BuildProfile, survey: str | None) -> DataFrame:
    df = prepare_raw(raw, prof, survey)
    if prof.compressor not in (None, "none") or isinstance(df.schema["data"].dataType, T.BinaryType):
        from ..sources.raw import decompress
        df = df.withColumn("data", decompress("data", prof.compressor or "none"))
    return df


def build_rejects(raw: DataFrame, profile: BuildProfile | Mapping, survey: str | None = None) -> DataFrame:
    """Rows of the build's scan whose payload does not decode: ``(survey?, id, submitted, version, data, lost)``.

    ``lost``: no other row of the scan holds a payload for the id that decodes.
    """
    from ..operators.store import _same_key
    from ..sources.raw import decode
    df = _scanned(raw, profile if isinstance(profile, BuildProfile) else parse_profile(profile), survey)
    keys = [c for c in ("survey", "id") if c in df.columns]
    bad = df.where(decode("data").isNull())
    whole = df.where(decode("data").isNotNull()).select(*keys).distinct().withColumn("_whole", F.lit(True))
    return bad.join(whole, _same_key(bad, whole, keys), "left").select(*[bad[c] for c in df.columns], F.col("_whole").isNull().alias("lost"))


def build_flat(raw: DataFrame, profile: BuildProfile | Mapping, survey: str | None = None,
               include_survey: bool | None = None) -> DataFrame:
    """Raw responses -> typed flat rows (one row per response id).

    ``raw`` has ``(survey?, id, submitted, version, data)``.  Of several copies
    of an id the first by (version, submitted, payload) that decodes is taken;
    the rows left out are those of ``build_rejects``.
    """
    from ..operators.store import first_per_key
    prof = profile if isinstance(profile, BuildProfile) else parse_profile(profile)
    df = _scanned(raw, prof, survey)
    has_survey = "survey" in df.columns
    s_col = F.col("survey") if has_survey else F.lit(None).cast("string")
    if prof.keys is not None:
        members, numbers = {m: list(k) for m, k in prof.keys.items()}, prof.numbers
        if prof.verify_keys:
            df = df.where(keys_listed(F.col("data"), members, s_col, F.col("version")))
    else:
        members, numbers = discover_schema(df, numbers=prof.infer_numbers)
    keys = sorted({k for ks in members.values() for k in ks})
    # The payload is parsed once per row (see ``evaluate_once``), then read field by field.
    dec = evaluate_once(df.select(s_col.alias(MEMBER_SURVEY), F.col("version").alias(MEMBER_VERSION), "id", "submitted", "data"),
                        _p=decode_struct(F.col("data"), keys)).where(payload_ok(F.col("_p"))).drop("data")
    if prof.dedupe:
        order = [version_array(F.col(MEMBER_VERSION)), F.col("submitted"), F.col("_p")]
        dec = first_per_key(dec, [MEMBER_SURVEY, "id"] if has_survey else ["id"], order)
    s_col, v_col = F.col(MEMBER_SURVEY), F.col(MEMBER_VERSION)
    index = {k: i for i, k in enumerate(keys)}
    plans = _payload_plans(members, numbers)
    lookup = lambda k: F.col("_p").getField(positional_name(index[k]))
    chain: list[Processor] = []
    for p in prof.processors:
        if not (isinstance(p, Custom) and p.fn is not None):
            chain.append(p)
            continue
        plans = run_processors(plans, chain)
        exprs = compile_projection(plans, lookup, s_col, v_col, prof.on_error)
        before = dec.select(s_col, v_col, *[e.alias(n) for n, e in exprs.items()])
        dec, chain = p.run(before), []
        if not {MEMBER_SURVEY, MEMBER_VERSION} <= set(dec.columns):
            raise ValueError(f"processor {p.name!r} must keep {MEMBER_SURVEY} and {MEMBER_VERSION}")
        types = {f.name: f.dataType.simpleString() for f in dec.schema.fields if f.name not in (MEMBER_SURVEY, MEMBER_VERSION)}
        added = [c for c in types if c not in before.columns]
        plans = {m: {c: ColumnSpec(c, base=types[c]) for c in [*[c for c in cols if c in types], *(added if p.applies_to(m[1]) else [])]}
                 for m, cols in plans.items()}
        lookup = lambda k: F.col(f"`{k}`")
    plans = run_processors(plans, chain)
    exprs = compile_projection(plans, lookup, s_col, v_col, prof.on_error)
    # JSON-typed columns parse text again (no code generation for JSON): they are
    # computed in their own one-row generator so the final projection stays in
    # whole-stage codegen.
    json_cols = sorted(t for t in exprs if _uses_json(plans, t))
    if json_cols:
        dec = evaluate_once(dec, _j=F.struct(*[exprs[t].alias(t) for t in json_cols]))
        exprs.update({t: F.col("_j").getField(t) for t in json_cols})
    out_cols = []
    if include_survey or (include_survey is None and has_survey):
        out_cols.append(s_col.alias("survey"))
    out_cols += [exprs[name].alias(name) for name in output_order(list(exprs))]
    return dec.select(*out_cols, *(["id"] if not exprs and "id" in dec.columns else []))


def build_held(raw: DataFrame, profile: BuildProfile | Mapping, survey: str | None = None, include_survey: bool | None = None,
               found: tuple[Mapping, Mapping] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """One load's flat rows for a table that other loads go to as well, and the kind of each column no rule types.

    Those columns are text (a JSON number as Spark writes it), so a load fits the
    stored files whatever its values are; ``write_keyed(kinds=...)`` records
    the kinds and ``read_keyed`` gives each column the widest of all loads.
    Custom functions see such columns as text in every load, and since they may
    change any column, their profile's untyped columns stay text.  So do keys that
    the profile gives with no numbers, and all with ``infer_numbers`` off.
    ``found``: keys and kinds of these very rows, if they are known.
    """
    prof = profile if isinstance(profile, BuildProfile) else parse_profile(profile)
    if found is not None:
        members, kinds = found
        prof = replace(prof, keys=members, numbers={}, verify_keys=False)
    elif prof.keys is not None:
        members, kinds = prof.keys, prof.numbers
        prof = replace(prof, numbers={})
    else:
        members, kinds = discover_kinds(_scanned(raw, prof, survey), numbers=prof.infer_numbers)
        prof = replace(prof, keys=members, numbers={}, verify_keys=False)
    flat = build_flat(raw, prof, survey, include_survey)
    text = {f.name for f in flat.schema.fields if isinstance(f.dataType, T.StringType)}
    custom = any(isinstance(p, Custom) and p.fn is not None for p in prof.processors)
    numbers = {k: x for k, x in kinds.items() if x in ("int", "float")} if prof.infer_numbers and not custom else {}
    seen: dict[str, set] = {}
    for plan in member_plans(members, prof, numbers).values():
        for name, spec in plan.items():
            if name in text:
                seen.setdefault(name, set()).add(spec.number or ("null" if not spec.ops and kinds.get(spec.key) == "null" else "text"))
    return flat, {c: widest(x) for c, x in sorted(seen.items())}


def version_dispatch_table(members: Mapping[tuple, Sequence[str]], profile: BuildProfile) -> list[tuple]:
    """O43 as data: (survey, version, processor names applied in order)."""
    rows = []
    for (survey, version) in sorted(members, key=lambda m: (m[0] or "", canonical(m[1]))):
        rows.append((survey, version, [p.name for p in profile.chain_for(version)]))
    return rows


def infer_column_types(si_rows: DataFrame, surveys: Sequence[str] | None = None,
                       versions: VersionSelector | None = None, column: str = "column") -> dict[str, dict]:
    """Schema inference from survey info: ``{survey: {column: type}}``.

    Question type -> column type (``multiple -> bool``, ``date -> date``,
    ``unknown -> json``, others text); one type per column, the latest
    version's (ties: the largest type name).  Computed by Spark, then brought
    to the driver: its size is the survey definitions.  Pass the result as the
    profile's ``inferred_schema``.
    """
    from ..operators.reconcile import latest_type, schema_rows_from_info
    rows = si_rows
    if surveys is not None:
        rows = rows.where(F.col("survey").isin(list(surveys)))
    if versions is not None and not versions.is_empty:
        rows = rows.where(versions.column(F.col("version")))
    types = schema_rows(latest_type(schema_rows_from_info(rows, column)), "set of survey columns")
    out: dict[str, dict] = {}
    for r in types:
        out.setdefault(r["survey"], {})[r["column"]] = r["type"]
    return out


def load_spec(path: str) -> dict:
    """A profile or plan file: YAML (when PyYAML is installed) or JSON."""
    import json
    import os
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    if os.path.splitext(path)[1].lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:  # optional dependency
            raise ImportError("reading a YAML profile needs PyYAML; use JSON instead") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def _plan_entries(plan: Mapping) -> list[tuple[str, object]]:
    """``surveys`` as a mapping ``{survey: config}`` (documented form) or a list of dicts."""
    surveys = plan.get("surveys") or {}
    if isinstance(surveys, Mapping):
        return list(surveys.items())
    out = []
    for entry in surveys:
        entry = dict(entry)
        s = entry.pop("survey")
        prof = entry.pop("profile", None)
        out.append((s, (prof, entry)))
    return out


def resolve_profile(config, profiles: Mapping, base_dir: str = ".") -> dict:
    """A plan entry -> profile dict: a dict, a profile name, ``'@file'`` (relative to
    the plan) or None (defaults only)."""
    import os
    overrides = {}
    if isinstance(config, tuple):
        config, overrides = config
    if config is None:
        prof = {}
    elif isinstance(config, str) and config.startswith("@"):
        prof = load_spec(os.path.join(base_dir, config[1:]))
    elif isinstance(config, str):
        if config not in profiles:
            raise KeyError(f"unknown profile {config!r}")
        prof = profiles[config]
    else:
        prof = config
    return {**prof, **overrides}


def build_plan(raw: DataFrame, plan: Mapping, base_dir: str = ".") -> dict[str, DataFrame]:
    """Several surveys from one partitioned source, each a lazy job with the number types of these rows.

    ``held_plan`` gives the same for tables that several loads go to.
    """
    out = {}
    for s, spec, found in _plan_specs(raw, plan, base_dir):
        if found is not None:
            numbers = {k: x for k, x in found[1].items() if x in ("int", "float")}
            # found in these very rows: nothing to verify
            spec = {**spec, "keys": found[0], "verify_keys": False, "numbers": numbers if spec.get("infer_numbers", True) else {}}
        out[s] = build_flat(raw, spec, survey=s, include_survey=True)
    return out


def held_plan(raw: DataFrame, plan: Mapping, base_dir: str = ".") -> dict[str, tuple[DataFrame, dict[str, str]]]:
    """``build_plan`` with ``build_held``: each survey's rows and the kinds of its columns."""
    return {s: build_held(raw, spec, s, True, found) for s, spec, found in _plan_specs(raw, plan, base_dir)}


def _plan_specs(raw: DataFrame, plan: Mapping, base_dir: str) -> list[tuple[str, dict, tuple | None]]:
    """(survey, its profile, its keys and kinds if they were found in these rows).

    ``plan = {'profiles': {name: profile}, 'surveys': {survey: profile | name |
    '@file' | None}, 'only': [...]}`` (a list of ``{'survey': s, 'profile':
    ...}`` also works).  Each survey is a separate lazy job over its own
    partition of the raw store; the shared ``defaults`` apply to every survey.
    """
    profiles = plan.get("profiles", {}) or {}
    shared = plan.get("defaults", {}) or {}
    only = set(plan.get("only") or [])
    entries = [(s, {**shared, **resolve_profile(c, profiles, base_dir)}) for s, c in _plan_entries(plan)
               if not only or s in only]
    # One key-discovery job for every survey that needs it, instead of one per survey.  Only
    # profiles without time bounds share it (their keys must come from the rows they build);
    # the shared keys are narrowed to each profile's versions.
    need = [s for s, spec in entries if spec.get("keys") is None and not spec.get("compressor")
            and spec.get("start_time") is None and spec.get("end_time") is None]
    members, kinds = discover_kinds(raw.where(F.col("survey").isin(need))) if need else ({}, {})
    out = []
    for s, spec in entries:
        found = None
        if s in need:
            sel = parse_selector(spec.get("versions"))
            found = {m: k for m, k in members.items() if m[0] == s and (sel.is_empty or sel.matches(m[1]))}, kinds
        out.append((s, spec, found))
    return out


REGISTRY_TABLE = "survey_response_table"
DIMENSION_TABLE = "survey_surveyuser"


def run_build_plan(spark, raw: DataFrame, plan: Mapping, target_dir: str, base_dir: str = ".") -> DataFrame:
    """O45/O46 end to end: build every survey of the plan and write its flat table
    (keyed on ``id`` with the profile's mode), extend the participant dimension
    (O34) by the participants seen, and record the tables (O33).

    All tables are under ``target_dir``; returns ``(survey, table, type,
    rows_written)`` of this run.
    """
    from ..operators.store import FLAT_TABLE_PREFIX, read_keyed, update_dimension, write_keyed
    profiles = plan.get("profiles", {}) or {}
    shared = plan.get("defaults", {}) or {}
    rows = []
    for s, (flat, kinds) in held_plan(raw, plan, base_dir).items():
        spec = {**shared, **resolve_profile(dict(_plan_entries(plan))[s], profiles, base_dir)}
        table = spec.get("target_table", FLAT_TABLE_PREFIX + "{survey}").format(survey=s)
        n = write_keyed(spark, f"{target_dir}/{table}", flat, ["id"], spec.get("mode", "ignore"), (), kinds=kinds)
        if "global_id" in flat.columns:
            update_dimension(spark, f"{target_dir}/{DIMENSION_TABLE}", read_keyed(spark, f"{target_dir}/{table}"))
        rows.append((s, table, "flat", int(n)))
    done = spark.createDataFrame(rows, "survey string, table string, type string, rows_written long")
    write_keyed(spark, f"{target_dir}/{REGISTRY_TABLE}", done.drop("rows_written"), ["table"], "ignore", ())
    return done
