"""Cleaning tools. Importing this package registers all of them."""

from clarifex.operators import basic, impute, model, scale, temporal, text  # noqa: F401
from clarifex.operators.registry import ToolContext, get_tool, list_tools, register, register_tool

__all__ = ["ToolContext", "get_tool", "list_tools", "register", "register_tool"]
