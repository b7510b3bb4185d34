"""SQL functions over logs."""

from .register import register

__all__ = ["register"]
