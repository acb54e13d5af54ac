"""Pages as images: the share of ink, and blank pages. Rasterising needs a PDF library, which callers inject."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from quillstage.functions.speech import lazy

DARK, BLANK_SHARE, MOST_BYTES, LEAST_DPI = 200, 0.001, 18_000_000, 110


def ink(gray: bytes | None) -> float:
    """Share of dark bytes of a grey image; 1.0 where there is none, which is never blank."""
    return float((np.frombuffer(gray, np.uint8) < DARK).mean()) if gray else 1.0


@lazy("double")
def ink_share(gray: pd.Series) -> pd.Series:
    return gray.map(ink)


def rendered(render: Callable[[int], bytes], dpi: int) -> tuple[bytes, list[int]]:
    """A page's image of bounded size: the resolution falls by a quarter until it fits. Returns the resolutions tried."""
    tried = [dpi]
    image = render(dpi)
    while len(image) > MOST_BYTES and tried[-1] > LEAST_DPI:
        tried.append(max(LEAST_DPI, int(tried[-1] * 0.75)))
        image = render(tried[-1])
    return image, tried
