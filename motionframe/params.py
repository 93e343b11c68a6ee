"""Parameters of the detection pipeline, and the profiles that reproduce its known variants."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DetectParams:
    """gray: weights "cpu", "gpu" (red and blue exchanged, single precision) or "rounded"; strict: threshold by > instead of >=.

    border: what a blur sees beyond the frame, "zero" (not renormalised) or "reflect101".
    morphology: "dilate_erode", "erode_dilate", "dilate" or "open_neutral" (erode, then dilate, the outside neutral,
    on an ellipse).  external: only components that the outside of the frame reaches.
    """

    ksize: int = 15
    sigma: float = 0.2
    threshold: int = 20
    maxval: int = 255
    morph_ksize: int = 15
    gray: str = "cpu"
    strict: bool = False
    border: str = "zero"
    morphology: str = "dilate_erode"
    external: bool = False
    label_base: int = 1

    def __post_init__(self) -> None:
        if self.ksize % 2 == 0 or self.morph_ksize % 2 == 0 or self.ksize < 1 or self.morph_ksize < 1:
            raise ValueError("kernel sizes are odd")
        if self.gray not in ("cpu", "gpu", "rounded") or self.border not in ("zero", "reflect101"):
            raise ValueError(f"unknown gray or border: {self.gray}, {self.border}")
        if self.morphology not in ("dilate_erode", "erode_dilate", "dilate", "open_neutral"):
            raise ValueError(f"unknown morphology: {self.morphology}")

    def but(self, **changes) -> DetectParams:
        return replace(self, **changes)


PROFILES = {
    "cpu": DetectParams(),
    "gpu": DetectParams(sigma=2.0, gray="gpu"),
    "gpu_per_frame": DetectParams(sigma=2.0, gray="gpu", morphology="dilate"),
    "opencv": DetectParams(gray="rounded", strict=True, border="reflect101", morphology="open_neutral", external=True),
}
