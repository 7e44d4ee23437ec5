"""Sentence builders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named descriptors that count as physicochemical.
PHYSICOCHEMICAL = (
    "MolWt", "MolLogP", "MolMR", "TPSA", "LabuteASA",
    "NumHDonors", "NumHAcceptors", "NumRotatableBonds",
    "NumHeteroatoms", "NumAliphaticRings", "NumAromaticRings",
    "NumSaturatedRings", "NumAliphaticHeterocycles", "NumAromaticHeterocycles",
    "NumSaturatedHeterocycles", "NumAliphaticCarbocycles", "NumAromaticCarbocycles",
    "NumSaturatedCarbocycles", "RingCount", "FractionCSP3",
    "HeavyAtomCount", "NHOHCount", "NOCount",
    "NumHeavyAtoms", "NumValenceElectrons",
)
# Risk wording per endpoint and wording of single descriptors in an interpretation.
RISK_WORDING = {
    "herg": "cardiotoxicity risk",
    "hepatotox": "hepatotoxicity risk",
    "nephrotox": "nephrotoxicity risk",
    "ames": "mutagenicity risk",
    "skin_sens": "skin sensitization risk",
    "cytotox": "cytotoxicity risk",
}
DEFAULT_RISK_WORDING = "toxicity risk"
DESCRIPTOR_WORDING = {
    "MolWt": "Molecular weight",
    "MolLogP": "Lipophilicity (LogP)",
    "TPSA": "Polar surface area",
    "NumHDonors": "H-bond donors",
    "NumHAcceptors": "H-bond acceptors",
    "NumAromaticRings": "Aromatic ring count",
}
# Notes on pharmacophore counts, with the count from which each applies.
PHARMACOPHORE_NOTES = (
    ("n_aromatic", 2, "Multiple aromatic rings may increase hERG binding risk"),
    ("n_hba", 5, "High HBA count - good for solubility, may affect permeability"),
    ("n_pos_ionizable", 1, "Positive ionizable groups increase CYP2D6 binding likelihood"),
)


def pick(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small literal table; ``default`` (or null) when the key is absent."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def feature_category(name: Column) -> Column:
    """Family of a feature by its name."""
    return (
        F.when(name.isin(*PHYSICOCHEMICAL), "physicochemical")
        .when(name.startswith("Morgan_"), "structural_fingerprints")
        .when(name.startswith("MACCS_"), "substructure_keys")
        .otherwise("uncategorised")
    )


def recommendation_text(level: Column, critical: Column) -> Column:
    """Advice line of an integrated assessment."""
    return (
        F.when(level == "low", F.lit("Compound shows low toxicity risk across endpoints"))
        .when(level == "moderate", F.concat(F.lit("Monitor "), critical, F.lit(" - moderate risk detected")))
        .when(
            level == "high",
            F.concat(F.lit("Caution: High "), critical, F.lit(" risk - consider structural optimization")),
        )
    )


def interpretation_text(top: Column, endpoint: Column) -> Column:
    """Summary of a ranked attribution array of struct(feature, value): strongest three per sign, then
    one remark for each named descriptor among the first five."""
    wording = pick(endpoint, RISK_WORDING, DEFAULT_RISK_WORDING)

    def names(sign_ok):
        return F.slice(F.transform(F.filter(top, sign_ok), lambda e: e["feature"]), 1, 3)

    up, down = names(lambda e: e["value"] > 0), names(lambda e: e["value"] < 0)
    remarks = F.transform(
        F.filter(F.slice(top, 1, 5), lambda e: e["feature"].isin(*DESCRIPTOR_WORDING)),
        lambda e: F.concat_ws(
            " ",
            pick(e["feature"], DESCRIPTOR_WORDING),
            F.when(e["value"] > 0, "increases").otherwise("decreases"),
            wording,
        ),
    )
    lead_up = F.when(F.size(up) > 0, F.concat(F.lit("Features increasing "), wording, F.lit(": "), F.array_join(up, ", ")))
    lead_down = F.when(F.size(down) > 0, F.concat(F.lit("Features decreasing "), wording, F.lit(": "), F.array_join(down, ", ")))
    text = F.concat_ws("; ", lead_up, lead_down, F.concat_ws("; ", F.when(F.size(remarks) > 0, remarks)))
    text = F.rtrim(F.regexp_replace(text, "; $", ""))
    return F.when(F.size(top) == 0, F.lit("No significant features identified.")).otherwise(
        F.when(text == "", F.lit("Analysis complete.")).otherwise(text)
    )


def pharmacophore_notes(**counts: Column) -> Column:
    """Array of the notes whose count is reached."""
    notes = [F.when(counts[name] >= least, F.lit(text)) for name, least, text in PHARMACOPHORE_NOTES if name in counts]
    return F.array_compact(F.array(*notes))
