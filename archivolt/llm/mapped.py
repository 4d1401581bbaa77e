"""Arrays as mapped files: see ``sources.mapped``."""

from ..sources.mapped import Mapped, deliver, mapped, pack, unpack

__all__ = ["Mapped", "deliver", "mapped", "pack", "unpack"]
