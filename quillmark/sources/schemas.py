"""Canonical schemas of the evaluation ledger."""

from __future__ import annotations

GENERATIONS = (
    "task_id string, task_type string, theory string, model string, sample int, output string, prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, generation_cost double, "
    "timestamp string, success boolean, error string, agentic_type string, metrics struct<total_turns:int,questions_asked:int,constraints_discovered:int,plan_quality:double,revision_count:int>"
)
EVALUATIONS = (
    "task_id string, task_type string, model string, sample int, evaluator_model string, evaluation_cost double, timestamp string, success boolean, final_score double, "
    "word_count_score double, programmatic double, llm_judge double, process_scores map<string,double>, output_scores map<string,double>, llm_results map<string,string>, error string, agentic_type string"
)
TASKS = "task_id string, task_type string, agentic_type string, theory string, difficulty string, word_count_min int, word_count_max int, payload string, file_path string"
TURNS = "generation_id string, turn_idx int, role string, turn_type string, content string, metadata map<string,string>"
