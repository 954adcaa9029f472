"""Schemas of the files that the sources read."""

from __future__ import annotations

MANIFEST = "array<struct<path: string, outcome: string, model: string, task: string>>"
TRACE = (
    "runId string, status string, turns array<struct<index: int, role: string, thinking: string, content: string, "
    "toolCalls: array<struct<id: string, name: string, args: string>>, toolCallId: string, subagentDepth: int>>"
)
TURNS = "run_id string, idx int, role string, thinking string, content string, tool_calls array<struct<id: string, name: string, args: string>>, tool_call_id string, subagent_depth int"
ATIF_STEP = (
    "struct<source: string, message: string, reasoning_content: string, timestamp: string, "
    "tool_calls: array<struct<tool_call_id: string, function_name: string, arguments: string>>, "
    "observation: struct<results: array<struct<source_call_id: string, content: string, subagent_trajectory_ref: array<struct<trajectory_path: string>>>>>>"
)
CAPTURE = "prompt_token_ids array<int>, token_ids array<int>, logprobs array<double>, model string, request_id string, finish_reason string, text string, request_started_at double, latency_ms double"
