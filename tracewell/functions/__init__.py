"""Scalar helpers of the optics notes: resolution limits of an objective."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FWHM_PER_SIGMA = 2 * math.sqrt(2 * math.log(2))


def psf_sigma(wavelength: Column, aperture: Column) -> Column:
    """Width of the Gaussian that stands for the point spread: 0.21 wavelength / aperture."""
    return F.lit(0.21) * wavelength / aperture


def fwhm(sigma: Column) -> Column:
    return sigma * FWHM_PER_SIGMA


def cutoff_frequency(wavelength: Column, aperture: Column) -> Column:
    """The highest spatial frequency that an objective passes: 2 aperture / wavelength."""
    return 2 * aperture / wavelength


def frame_to_ms(frame: Column, rate_hz: float = 20.0) -> Column:
    return frame * (1000.0 / rate_hz)
