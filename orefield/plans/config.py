"""Parameters of a run: flat keys with defaults, as a parameter file gives them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

#: Every key and its default. "@" stands for both problems, grav and magn, with a default each.
_DEFAULTS: dict[str, Any] = {
    "global.outputFolderPath": "output/test/", "global.description": "", "global.@.dataUnitsMultiplier": (1.0, 1.0), "global.@.modelUnitsMultiplier": (1.0, 1.0), "global.zAxisDirection": 1,
    "output.paraview.@.modelLabel": ("rho", "k"),
    "modelGrid.size": [0, 0, 0], "modelGrid.@.file": ("", ""), "modelGrid.magn.nModelComponents": 1,
    "forward.data.@.nData": (0, 0), "forward.data.@.dataGridFile": ("", ""), "forward.data.@.dataValuesFile": ("", ""), "forward.data.@.nDataComponents": (1, 1), "forward.data.grav.type": 1,
    "forward.data.@.useError": (0, 0), "forward.data.@.errorFile": ("", ""), "forward.data.@.useSyntheticModelForDataValues": (0, 0), "forward.data.@.syntheticModelFile": ("", ""),
    "forward.magneticField.inclination": 90.0, "forward.magneticField.declination": 0.0, "forward.magneticField.intensity_nT": 50000.0, "forward.magneticField.XaxisDeclination": 0.0,
    "forward.depthWeighting.type": 2, "forward.depthWeighting.@.power": (2.0, 3.0), "forward.depthWeighting.@.beta": (1.0, 1.0), "forward.depthWeighting.@.Z0": (0.0, 0.0),
    "forward.depthWeighting.applyLocalWeight": 0, "forward.depthWeighting.@.file": ("", ""),
    "sensit.readFromFiles": 0, "sensit.folderPath": "SENSIT/", "forward.matrixCompression.type": 0, "forward.matrixCompression.rate": 0.1,
    "inversion.priorModel.type": 1, "inversion.priorModel.nModels": 1, "inversion.priorModel.@.value": (0.0, 0.0), "inversion.priorModel.@.file": ("", ""),
    "inversion.startingModel.type": 1, "inversion.startingModel.@.value": (0.0, 0.0), "inversion.startingModel.@.file": ("", ""),
    "inversion.nMajorIterations": 10, "inversion.nMinorIterations": 100, "inversion.targetMisfit": 0.0, "inversion.writeModelEveryNiter": 0, "inversion.minResidual": 1e-13, "inversion.solver": 1, "inversion.softThresholdL1": 0.0,
    "inversion.modelDamping.@.weight": (1e-11, 1e-8), "inversion.modelDamping.normPower": 2.0, "inversion.modelDamping.applyLocalWeight": 0, "inversion.modelDamping.@.file": ("", ""),
    "inversion.joint.@.problemWeight": (1.0, 0.0), "inversion.joint.@.columnWeightMultiplier": (4e3, 1.0),
    "inversion.admm.enableADMM": 0, "inversion.admm.boundType": 1, "inversion.admm.nLithologies": 1, "inversion.admm.@.bounds": ([], []), "inversion.admm.@.boundsFile": ("", ""), "inversion.admm.@.weight": (1e-7, 1e5),
    "inversion.admm.dataCostThreshold": 1e-4, "inversion.admm.weightMultiplier": 1.0, "inversion.admm.maxWeight": 1e10,
    "inversion.dampingGradient.weightType": 1, "inversion.dampingGradient.@.weight": (0.0, 0.0), "inversion.dampingGradient.@.weightsFile": ("", ""),
    "inversion.crossGradient.weight": 0.0, "inversion.crossGradient.derivativeType": 1, "inversion.crossGradient.@.keepModelConstant": (0, 0), "inversion.crossGradient.vectorFieldType": 0, "inversion.crossGradient.vectorFieldFile": "",
    "inversion.clustering.@.weight": (0.0, 0.0), "inversion.clustering.nClusters": 4, "inversion.clustering.mixtureFile": "", "inversion.clustering.cellWeightsFile": "", "inversion.clustering.optimizationType": 2, "inversion.clustering.constraintsType": 2,
}
PROBLEMS = ("grav", "magn")


def defaults() -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in _DEFAULTS.items():
        if "@" in key:
            out |= {key.replace("@", p): v for p, v in zip(PROBLEMS, value, strict=True)}
        else:
            out[key] = value
    return out


def number(text: str) -> float:
    """A number whose exponent may be written with d."""
    return float(text.lower().replace("d", "e"))


def parsed(text: str, like: Any) -> Any:
    words = text.split()
    if isinstance(like, str):
        return text.strip() if text.strip() not in ("None", "NILL") else ""
    if isinstance(like, list):
        return [int(w) if like and isinstance(like[0], int) else number(w) for w in words if w != "None"]
    return int(number(words[0])) if isinstance(like, int) else number(words[0])


@dataclass(frozen=True)
class Config:
    """All parameters, by key. Unknown keys warn; lines without a key and lines that begin with # are passed over; order is free."""

    values: dict[str, Any] = field(default_factory=defaults)

    @staticmethod
    def parse(lines: list[str]) -> Config:
        values = defaults()
        for line in lines:
            key, equals, text = line.rstrip("\n").partition("=")
            key = key.strip()
            if line.startswith("#") or not equals or not key:
                continue
            if key not in values:
                warnings.warn(f"unknown parameter {key!r}", stacklevel=2)
                continue
            values[key] = parsed(text, values[key])
        return Config(values).checked()

    def checked(self) -> Config:
        if self["modelGrid.magn.nModelComponents"] == 3 and self["inversion.joint.grav.problemWeight"] != 0:
            raise ValueError("magnetisation vectors cannot be solved jointly with gravity")
        if self["inversion.crossGradient.derivativeType"] not in (1, 2):
            raise ValueError("the cross-gradient takes derivatives of type 1 (forward) or 2 (central)")
        if self["forward.data.grav.nDataComponents"] not in (1, 6) or self["forward.data.magn.nDataComponents"] not in (1, 3):
            raise ValueError("gravity data have 1 or 6 components, magnetic data 1 or 3")
        return self

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    def of(self, key: str, problem: str) -> Any:
        return self.values[key.replace("@", problem)]

    def active(self) -> list[str]:
        return [p for p in PROBLEMS if self.of("inversion.joint.@.problemWeight", p) != 0]

    def rows(self) -> list[tuple[str, str]]:
        return [(k, " ".join(map(str, v)) if isinstance(v, list) else str(v)) for k, v in sorted(self.values.items())]
