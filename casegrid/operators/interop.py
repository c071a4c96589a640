"""Interchange documents: bundles, delimited messages, prompts, and entities read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: System URIs, vital-sign codes, codes that must be components of a panel, and codes that carry a second coding.
SYSTEM_URI = {"SNOMED": "http://snomed.info/sct", "LOINC": "http://loinc.org", "RXNORM": "http://www.nlm.nih.gov/research/umls/rxnorm"}
PRESSURE = ["8480-6", "8462-4"]
PANEL_PARTS = ["39156-5", "8287-5"]
VITALS = ["8480-6", "8462-4", "8867-4", "8310-5", "9279-1", "8302-2", "29463-7", "59408-5", "2708-6", "2710-2", "85354-9", "85353-3", "8716-3", "3141-9"]
SECOND_CODE = {"2710-2": "2708-6", "3141-9": "29463-7"}
PRESSURE_PANEL, VITAL_PANEL = "85354-9", "85353-3"
VITAL_DATE = "2026-01-01"
#: HL7 names and codes of vital signs, in order.
HL7_VITALS = [("temp", "8310-5", "Body temperature", "Cel"), ("hr", "8867-4", "Heart rate", "/min"), ("rr", "9279-1", "Respiratory rate", "/min"), ("spo2", "2708-6", "Oxygen saturation", "%"), ("sbp", "8480-6", "Systolic blood pressure", "mm[Hg]")]

#: Coded answers of the interchange format.
ABSENT = ("http://terminology.hl7.org/CodeSystem/data-absent-reason", "unknown")
VITAL_CATEGORY = ("http://terminology.hl7.org/CodeSystem/observation-category", "vital-signs", "Vital Signs")
ACTIVE = ("http://terminology.hl7.org/CodeSystem/condition-clinical", "active")

_CODING = "struct<system:string,code:string,display:string>"
_CONCEPT = f"struct<coding:array<{_CODING}>>"
#: one shape for all resources: fields that a resource doesn't have are null, and ``to_json`` leaves them out
RESOURCE = {
    "resourceType": "string", "id": "string", "meta": "struct<source:string>", "status": "string", "title": "string", "subject": "struct<reference:string>",
    "clinicalStatus": _CONCEPT, "category": f"array<{_CONCEPT}>", "code": _CONCEPT, "medicationCodeableConcept": _CONCEPT, "effectiveDateTime": "string",
    "dataAbsentReason": _CONCEPT, "component": f"array<struct<code:{_CONCEPT},dataAbsentReason:{_CONCEPT}>>",
}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _concept(first: Column, *more: Column) -> Column:
    """A concept of a coding and others, each of which may be null; without others it is a constant or plain structure, nothing to filter."""
    codings = F.array(first)
    return F.struct((F.concat(codings, F.array_compact(F.array(*more))) if more else codings).alias("coding"))


def _fixed(values: tuple[str, ...]) -> Column:
    return F.struct(*[F.lit(v).cast("string").alias(name) for v, name in zip((*values, None), ("system", "code", "display"))])


def _entry(kind: str, url: Column, **fields: Column) -> Column:
    """An entry with the fields of the common shape, null where not given."""
    fields["resourceType"] = F.lit(kind)
    resource = F.struct(*[(fields[name] if name in fields else F.lit(None).cast(shape)).alias(name) for name, shape in RESOURCE.items()])
    return F.struct(url.alias("fullUrl"), resource.alias("resource"))


class Entries:
    """Entries of a case: the patient's id, maps from "SYSTEM|code" to display and from code to source, either of which may be null, and the codes that are vital signs."""

    def __init__(self, patient: Column, displays: Column | None = None, sources: Column | None = None, vitals: list[str] = VITALS):
        self.patient, self.displays, self.sources, self.vitals = patient, displays, sources, vitals

    def coding(self, system: str, code: Column) -> Column:
        shown = F.lit(None).cast("string") if self.displays is None else F.try_element_at(self.displays, _text(system, "|", code))
        return F.struct(F.lit(SYSTEM_URI[system]).alias("system"), code.alias("code"), shown.alias("display"))

    def of(self, kind: str, prefix: str, number: Column, **fields: Column) -> Column:
        source = F.lit(None).cast("string") if self.sources is None else F.try_element_at(self.sources, number)
        meta = F.when(F.coalesce(source, F.lit("")) != "", F.struct(source.alias("source")))
        subject = F.struct(_text("urn:case:patient-", self.patient).alias("reference"))
        return _entry(kind, _text("urn:case:", prefix, "-", number), id=_text(prefix, "-", number), subject=subject, meta=meta, **fields)

    def person(self) -> Column:
        return _entry("Patient", _text("urn:case:patient-", self.patient), id=self.patient)

    def condition(self, code: Column) -> Column:
        return self.of("Condition", "condition", code, code=_concept(self.coding("SNOMED", code)), clinicalStatus=_concept(_fixed(ACTIVE)))

    def medication(self, code: Column) -> Column:
        return self.of("MedicationStatement", "medication", code, status=F.lit("unknown"), medicationCodeableConcept=_concept(self.coding("RXNORM", code)))

    def observation(self, code: Column) -> Column:
        """A code alone, or, where the standard asks for it, as the component of a panel; vital signs have a category, a date and no value."""
        pressure, panel_part, vital = code.isin(PRESSURE), code.isin(PANEL_PARTS), code.isin(self.vitals)
        part = lambda c: F.struct(_concept(self.coding("LOINC", c)).alias("code"), _concept(_fixed(ABSENT)).alias("dataAbsentReason"))
        second = F.try_element_at(F.create_map(*[F.lit(x) for pair in SECOND_CODE.items() for x in pair]), code)
        own = F.when(pressure, F.lit(PRESSURE_PANEL)).when(panel_part, F.lit(VITAL_PANEL)).otherwise(code)
        in_panel = pressure | panel_part
        return self.of(
            "Observation",
            "observation",
            code,
            **{
                "status": F.lit("final"),
                "code": _concept(self.coding("LOINC", own), F.when(~in_panel & second.isNotNull(), self.coding("LOINC", second))),
                "category": F.when(in_panel | vital, F.array(_concept(_fixed(VITAL_CATEGORY)))),
                "effectiveDateTime": F.when(in_panel | vital, F.lit(VITAL_DATE)),
                "dataAbsentReason": F.when(vital & ~in_panel, _concept(_fixed(ABSENT))),
                "component": F.when(pressure, F.array(*[part(F.lit(c)) for c in PRESSURE])).when(panel_part, F.array(part(code))),
            },
        )

    def all(self, conditions: Column, loincs: Column, rxnorms: Column) -> Column:
        """The patient, then conditions, observations and drugs in order; null codes are left out."""
        there = lambda codes: F.array_compact(codes)
        return F.concat(F.array(self.person()), F.transform(there(conditions), self.condition), F.transform(there(loincs), self.observation), F.transform(there(rxnorms), self.medication))


def bundle(patient: Column, conditions: Column, loincs: Column, rxnorms: Column, displays: Column | None = None, sources: Column | None = None, vitals: list[str] = VITALS) -> Column:
    """A collection Bundle as JSON text; codes outside ``vitals`` are laboratory tests, unless they belong to a panel."""
    entries = Entries(patient, displays, sources, vitals).all(conditions, loincs, rxnorms)
    return F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), entries.alias("entry")))


def document_bundle(case_id: Column, entries: Column) -> Column:
    """A document Bundle: composition, encounter and organization, with ids derived from the case, then the entries."""
    make = lambda kind: F.substring(F.sha2(_text(kind, ":", case_id), 256), 1, 32)
    head = [
        _entry(kind, _text("urn:uuid:", make(kind)), id=make(kind), **{name: F.lit(v) for name, v in more.items()})
        for kind, more in (("Composition", {"status": "final", "title": "Case report"}), ("Encounter", {"status": "finished"}), ("Organization", {}))
    ]
    return F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("document").alias("type"), F.concat(F.array(*head), entries).alias("entry")))


def entities(json: Column) -> Column:
    """Array of struct(pos, axis, c: struct(system, code, display)) of a bundle's resources on the four axes, in order; blood pressure goes back to its own component, an observation without a category is a lab."""
    coding = "struct<system:string,code:string,display:string>"
    concept = f"struct<coding:array<{coding}>>"
    schema = f"struct<entry:array<struct<resource:struct<resourceType:string,id:string,code:{concept},medicationCodeableConcept:{concept},category:array<{concept}>,component:array<struct<code:{concept}>>>>>>"
    first = lambda c: F.get(c["coding"], F.lit(0))

    def entity(e: Column, pos: Column) -> Column:
        r = e["resource"]
        kind = r["resourceType"]
        vital = F.exists(r["category"], lambda c: F.exists(c["coding"], lambda x: x["code"] == "vital-signs"))
        axis = F.when(kind == "Condition", "condition").when(kind == "Observation", F.when(vital, "vital").otherwise("lab")).when(kind.isin("MedicationStatement", "MedicationRequest"), "medication")
        own = F.get(F.filter(F.transform(r["component"], lambda c: first(c["code"])), lambda c: F.concat(F.lit("observation-"), c["code"]) == r["id"]), F.lit(0))
        picked = F.when(kind == "Observation", F.coalesce(own, first(r["code"]))).when(kind == "Condition", first(r["code"])).otherwise(first(r["medicationCodeableConcept"]))
        return F.struct(pos.alias("pos"), axis.alias("axis"), picked.alias("c"))

    return F.filter(F.transform(F.from_json(json, schema)["entry"], entity), lambda e: e["axis"].isNotNull() & e["c"]["code"].isNotNull())


def bundle_entities(rows: DataFrame, id_column: str, json: str) -> DataFrame:
    """Id, pos, axis, code_system, code of the ``entities`` of each bundle."""
    opened = rows.select(id_column, F.explode(entities(F.col(json))).alias("e"))
    return opened.select(id_column, "e.pos", "e.axis", F.col("e.c.system").alias("code_system"), F.col("e.c.code").alias("code"))


def bundle_codings(rows: DataFrame, id_column: str, json: str) -> DataFrame:
    """Id, pos, coding, kind, code_system, code, display: every coding of conditions, observations and medication statements, in order.

    An observation's kind is by the first coding of its first category. What a coding
    lacks is the empty text; a text that is no bundle has no codings.
    """
    concept = "struct<coding:array<struct<system:string,code:string,display:string>>>"
    schema = f"struct<entry:array<struct<resource:struct<resourceType:string,code:{concept},medicationCodeableConcept:{concept},category:array<{concept}>>>>>"
    r = rows.select(id_column, F.posexplode(F.from_json(F.col(json), schema)["entry"]).alias("pos", "e")).select(id_column, "pos", F.col("e.resource").alias("r"))
    category = F.get(F.get("r.category", F.lit(0))["coding"], F.lit(0))["code"]
    of = F.col("r.resourceType")
    kind = F.when(of == "Observation", F.when(category == "laboratory", "Observation (Lab)").when(category == "vital-signs", "Observation (Vital)").otherwise("Observation")).otherwise(of)
    codings = F.when(of.isin("Condition", "Observation"), F.col("r.code.coding")).when(of == "MedicationStatement", F.col("r.medicationCodeableConcept.coding"))
    out = r.select(id_column, "pos", kind.alias("kind"), F.posexplode(codings).alias("coding", "c"))
    return out.select(id_column, "pos", "coding", "kind", *[F.coalesce(f"c.{f}", F.lit("")).alias(name) for f, name in (("system", "code_system"), ("code", "code"), ("display", "display"))])


#: Characters of a message that have a meaning of their own, and how they are written in a value.
HL7_ESCAPES = (("\\", "\\E\\"), ("|", "\\F\\"), ("^", "\\S\\"), ("&", "\\T\\"), ("~", "\\R\\"), ("\r", "\\X0D\\"), ("\n", "\\X0A\\"))


def hl7_escaped(value: Column) -> Column:
    """A value that can't add fields, components or segments."""
    for plain, written in HL7_ESCAPES:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def hl7_unescaped(value: Column) -> Column:
    """The value again: between the escape characters stand plain text and codes in turn."""
    codes = F.create_map(*[F.lit(x) for plain, written in HL7_ESCAPES for x in (written.strip("\\"), plain)])
    parts = F.transform(F.split(value, "\\\\"), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.coalesce(F.try_element_at(codes, x), x)))
    return F.array_join(parts, "")


def hl7_report(header: dict[str, Column], conditions: Column, labs: Column, vitals: dict[str, Column], meds: Column) -> Column:
    """Segments joined by carriage returns: MSH, PID, PV1, DG1..., OBX of labs then vitals, RXA.

    header: facility, at, message_id, patient_id, family, given, birth, sex, race, city, state, zip, phone, ethnicity, visit_date (compact dates).
    conditions: array of struct(code, name); labs: struct(code, name, result_code, result, date); meds: struct(code, name). Values are escaped.
    """
    h = {k: hl7_escaped(F.coalesce(v, F.lit(""))) for k, v in header.items()}
    e = hl7_escaped
    msh = _text("MSH|^~\\&|CASEGRID|", h["facility"], "|SURVEILLANCE|LHD|", h["at"], "||ORU^R01^ORU_R01|", h["message_id"], "|P|2.5.1")
    pid = _text("PID|1||", h["patient_id"], "||", h["family"], "^", h["given"], "||", h["birth"], "|", h["sex"], "||", h["race"], "|^^^^^", h["city"], "^", h["state"], "^", h["zip"], "^US||", h["phone"], "||||||||", h["ethnicity"])
    pv1 = _text("PV1|1|O|||||||||||||||||V|", h["visit_date"])
    number = lambda i, base=0: (i + 1 + base).cast("string")
    dg1 = F.transform(conditions, lambda c, i: _text("DG1|", number(i), "||", e(c["code"]), "^", e(c["name"]), "^SCT||", h["visit_date"], "|A"))
    obx = F.transform(labs, lambda x, i: _text("OBX|", number(i), "|CWE|", e(x["code"]), "^", e(x["name"]), "^LN||", e(x["result_code"]), "^", F.when(x["result"] == "", "N/A").otherwise(e(x["result"])), "^SCT||||||F|||", F.regexp_replace(x["date"], "-", "")))
    listed = F.array_compact(F.array(*[F.when(vitals[k].isNotNull(), F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), vitals[k].cast("string").alias("value"), F.lit(unit).alias("unit"))) for k, code, name, unit in HL7_VITALS if k in vitals])) if vitals else F.array().cast("array<struct<code:string,name:string,value:string,unit:string>>")
    more = F.transform(listed, lambda v, i: _text("OBX|", (i + 1 + F.size(labs)).cast("string"), "|NM|", v["code"], "^", v["name"], "^LN||", e(v["value"]), "|", v["unit"], "|||||F|||", h["visit_date"]))
    rxa = F.transform(meds, lambda m: _text("RXA|0|1|", h["visit_date"], "||", e(m["code"]), "^", e(m["name"]), "^RxNorm|1||"))
    return F.array_join(F.concat(F.array(msh, pid, pv1), dg1, obx, more, rxa), "\r")


def prompt(lines: list[tuple[str, Column]]) -> Column:
    """Labelled lines in a fixed order; absent values leave no line."""
    return F.concat_ws("\n", *[F.when(c.isNotNull() & (c != ""), _text(f"{label}: ", c)) for label, c in lines])


def field_changes(rows: DataFrame, keys: list[str], labs: tuple[str, str], vitals: list[tuple[str, str]], demographics: list[tuple[str, str]]) -> DataFrame:
    """Keys, lab_changes, vital_changes, demographic_changes, summary.

    labs: (prior, current) columns of map<code, result>: a lab counts if it is
    new, gone or has another result. A vital counts if it moved by more than
    0.01 or appeared or disappeared; demographics only if the new value is not empty.
    """
    old, new = F.col(labs[0]), F.col(labs[1])
    all_codes = F.array_sort(F.array_union(F.coalesce(F.map_keys(old), F.array()), F.coalesce(F.map_keys(new), F.array())))
    lab = F.filter(all_codes, lambda c: ~F.try_element_at(old, c).eqNullSafe(F.try_element_at(new, c)))
    moved = [F.when(F.col(a).isNull() != F.col(b).isNull(), b).when(F.abs(F.col(a) - F.col(b)) > 0.01, b) for a, b in vitals]
    who = [F.when((F.coalesce(F.col(b), F.lit("")) != "") & ~F.col(a).eqNullSafe(F.col(b)), b) for a, b in demographics]
    pick = lambda columns: F.array_compact(F.array(*columns)) if columns else F.array().cast("array<string>")
    said = lambda what, c: F.when(F.size(c) > 0, _text(f"{what}: ", F.array_join(c, ", ")))
    out = rows.select(*keys, lab.alias("lab_changes"), pick(moved).alias("vital_changes"), pick(who).alias("demographic_changes"))
    text = F.concat_ws("; ", said("labs", F.col("lab_changes")), said("vitals", F.col("vital_changes")), said("demographics", F.col("demographic_changes")))
    return out.withColumn("summary", F.when(text == "", "no changes").otherwise(text))
