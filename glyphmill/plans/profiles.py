"""What a job needs to know: prompts, budget, naming rules, routes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# ---------------------------------------------------------------------------
# The shipped profiles and the names used in profile files.
# ---------------------------------------------------------------------------

_GDSCRIPT_TASKS = {
    "full": "Migrate this Unity C# code to GDScript class. Code to migrate:\n${CODE}\n",
    "class_only": (
        "This Unity C# class has methods removed. Migrate this Unity class  to GDScript class. "
        "Insert ${METHODS} string where class methods should be placed. Class to migrate:\n${CODE}\n"
    ),
    "methods_only": "Migrate these methods from a Unity C# class to GDScript class. Methods to migrate:\n${CODE}\n",
}

_GDSCRIPT_SOURCE = {
    "ignore_locations": ["Library", "ExternalLibraries", "Packages"],
    "csharp": {"convert_macros_to_comments": True},
}

_GDSCRIPT_TARGET = {
    "convert_spaces_to_tabs": True,
    "convert_tabs_to_spaces": False,
    "convert_filename_to_camelcase": False,
    "convert_filename_to_snake_case": True,
    "lower_folder_names": True,
    "extension": ".gd",
}

_GODOT_PAIRS = {
    "target_engine": "godot",
    "embedding_function": "krlvi/sentence-t5-base-nlpl-code_search_net",
    "user_request": (
        "Remember this correct translation from Unity: \n```\n${SOURCE}\n```\nis translated as:\n```\n${TARGET}\n```\n"
    ),
    "assistant_response": "Certainly! I will remember this translation.",
}

SINGLE_FILE = "CSharpCompilationUnitToSingleFileWithLLM"
TWO_FILES = "CSharpCompilationUnitToInterfaceImplementationWithLLM"

PROFILES: dict[str, dict[str, Any]] = {
    "godot": {
        "prompts": {
            "system": (
                "You are professional Unity engineer who is migrating a large project from Unity platform to Godot 4.1. "
                "Migrate code to GDScript, which you are an expert in. Follow the following rules:\n"
                "1. Output code only, put explanations as comments.\n"
                "2. Do not skip any logic.\n"
                "3. Preserve all comments without changing.\n"
                '4. If migration is impossible leave "TODO [Migrate]" comment.\n'
                "5. Use GDScript best practices.\n"
                "6. Convert camelCase variable names and method names to snake_case.\n"
                "7. Unity namespaces should migrate into 'class_name' directive. \n"
                "8. Unity class should migrate into 'class_name' directive. \n"
            ),
            **_GDSCRIPT_TASKS,
        },
        "llm": {"class": "ChatGptLLM", "config": {"model": "gpt-3.5-turbo-16k", "max_tokens": 10000}},
        "source": _GDSCRIPT_SOURCE,
        "target": _GDSCRIPT_TARGET,
        "known_translations": {**_GODOT_PAIRS, "result_count": 5},
        "strategies": {".cs": SINGLE_FILE},
    },
    "godot-huggingface": {
        "prompts": {
            "system": (
                "You are professional Unity engineer who is migrating a large project from Unity platform to Godot 4.1. "
                "Migrate code to GDScript, which you are an expert in. Follow the following rules:\n"
                "1. Output code only, put explanations as comments.\n"
                "2. Wrap your code with ``` (three ticks)\n"
                "3. Do not skip any logic.\n"
                "4. Preserve all comments without changing.\n"
                '5. If migration is impossible leave "TODO [Migrate]" comment.\n'
                "6. Use GDScript best practices.\n"
                "7. Convert camelCase variable names and method names to snake_case.\n"
                "8. Unity namespaces should migrate into 'class_name' directive. \n"
                "9. Unity class should migrate into 'class_name' directive. \n"
            ),
            **_GDSCRIPT_TASKS,
        },
        "llm": {
            "class": "HuggingfaceLLM",
            "config": {
                "checkpoint": "TheBloke/CodeLlama-34B-Instruct-GGUF",
                "context_length": 4096,
                "model_type": "llama",
                "gpu_layers": 50,
                "prompt_template": "[INST]:\n${PROMPT}\n[/INST]\n",
            },
        },
        "source": _GDSCRIPT_SOURCE,
        "target": _GDSCRIPT_TARGET,
        "known_translations": {**_GODOT_PAIRS, "result_count": 3},
        "strategies": {".cs": SINGLE_FILE},
    },
    "godot-mono": {
        "prompts": {
            "system": (
                "You are a professional Unity game developer who is migrating a project from the Unity platform to Godot 4.1.\n"
                "To migrate the Unity C# code to Godot C#, which you are an expert in. Follow the following rules:\n"
                "1. Output code only, put any explanations as comments.\n"
                "2. Do not skip any logic.\n"
                "3. Preserve all comments without altering them.\n"
                '4. If migration is impossible, leave a "TODO: Should migrate" comment.\n'
                "5. Use C# best practices.\n"
                "6. Make all Unity code use Godot's node-based system.\n"
                '7. Replace the inherited "MonoBehaviour" class with the appropriate type inheriting from `Node`. \n'
            ),
            "full": "Please migrate this Unity code to Godot C# code. Here is the code you should migrate:\n${CODE}\n",
            "class_only": (
                "This Unity C# class has methods removed. Migrate this Unity class to a Godot C# class. "
                "Insert ${METHODS} string where class methods should be placed. Class to migrate:\n${CODE}\n"
            ),
            "methods_only": "Migrate these methods from a Unity C# class to a Godot C# class. Methods to migrate:\n${CODE}\n",
        },
        "llm": {"class": "ChatGptLLM", "config": {"model": "gpt-3.5-turbo", "max_tokens": 4000}},
        "source": {
            "ignore_locations": ["Library", "ExternalLibraries", "Packages"],
            "csharp": {"convert_macros_to_comments": False},
        },
        "target": {
            "convert_spaces_to_tabs": True,
            "convert_tabs_to_spaces": False,
            "convert_filename_to_camelcase": False,
            "convert_filename_to_snake_case": False,
            "lower_folder_names": True,
            "extension": ".cs",
        },
        "strategies": {".cs": SINGLE_FILE},
    },
    "unreal": {
        "prompts": {
            "system": (
                "You are professional Unity engineer who is migrating a large project from Unity platform to Unreal Engine 4. "
                "Migrate code to C++, which you are an expert in. Follow the following rules:\n"
                "1. Always output exactly two code blocks: one with headers and other with implementations.\n"
                "2. Do not skip any logic.\n"
                "3. Preserve all comments without changing.\n"
                '4. If migration is impossible leave "TODO [Migrate]" comment.\n'
                "5. Use Unreal Engine C++ best practices.\n"
            ),
            "full": "Migrate this Unity C# code to Unreal Engine C++ header and implementation. Code to migrate:\n${CODE}\n",
            "class_only": (
                "This Unity C# class has methods removed. Migrate this Unity class to Unreal Engine C++ class header "
                "and implementation. Insert ${METHODS} string in the header where class methods should be placed. "
                "Class to migrate:\n${CODE}\n"
            ),
            "methods_only": (
                "Migrate these methods from a Unity C# class to Unreal Engine C++ header and implementation. "
                "Methods to migrate:\n${CODE}\n"
            ),
        },
        "llm": {"class": "ChatGptLLM", "config": {"model": "gpt-3.5-turbo", "max_tokens": 4000}},
        "source": {
            "ignore_locations": ["Library", "ExternalLibraries", "Packages"],
            "csharp": {"convert_macros_to_comments": True},
        },
        "target": {
            "convert_tabs_to_spaces": True,
            "convert_filename_to_camelcase": True,
            "header_extension": ".h",
            "implementation_extension": ".cpp",
        },
        "strategies": {".cs": TWO_FILES},
    },
}

# Pairs that go with the ``godot`` profiles (source, target).
GODOT_PAIRS: list[tuple[str, str]] = [
    (
        "variable = {condition} ? (true_statement) : (false_statement);\n",
        "variable = {translated_true_statement} if {translated_condition} else {translated_false_statement}\n",
    ),
    (
        "private void Start()\n{\n  {function_body}\n}\n",
        "func _ready() -> void:\n{\n  {translated_function_body}\n}\n",
    ),
    (
        "private void OnEnable()\n{\n  {function_body}\n}\n",
        "func _enter_tree() -> void:\n{\n  {translated_function_body}\n}\n",
    ),
    (
        "private void OnDisable()\n{\n  {function_body}\n}\n",
        "func _exit_tree() -> void:\n{\n  {translated_function_body}\n}\n",
    ),
    (
        "private void FixedUpdate()\n{\n  {function_body}\n}\n",
        "func _physics_process(delta: float) -> void:\n{\n  {translated_function_body}\n}\n",
    ),
    (
        "private void Update()\n{\n  {function_body}\n}\n",
        "func _process(delta: float) -> void:\n{\n  {translated_function_body}\n}\n",
    ),
]
PAIRS_BY_ENGINE = {"godot": GODOT_PAIRS}

# ---------------------------------------------------------------------------


class ProfileError(RuntimeError):
    """The profile is unknown or cannot be used."""


@dataclass(frozen=True)
class KnownPairs:
    """How known pairs become history; ``engine`` names the pair list."""

    engine: str | None
    embedding: str | None
    count: int
    user_request: str
    assistant_response: str


@dataclass(frozen=True)
class Profile:
    prompts: dict[str, str | None]
    provider: str | None
    provider_settings: dict[str, Any] = field(default_factory=dict)
    limit: int | None = None
    ignore: list[str] = field(default_factory=list)
    directives_to_comments: bool = False
    tabs_to_spaces: bool = False
    spaces_to_tabs: bool = False
    camel_case_names: bool = False
    snake_case_names: bool = False
    lower_folders: bool = False
    extension: str = ""
    header_extension: str = ""
    implementation_extension: str = ""
    known: KnownPairs | None = None
    strategies: dict[str, str | None] = field(default_factory=dict)


def from_config(config: dict[str, Any]) -> Profile:
    """A profile from a nested configuration; whatever is missing counts as unset."""

    def get(*path):
        value = config
        for key in path:
            value = value.get(key) if isinstance(value, dict) else None
        return value

    if "llm" not in config:
        raise ProfileError("the configuration has no 'llm' section")
    model = get("llm", "llm_config") or get("llm")
    settings = dict(model.get("config") or {})
    wrapper = get("llm", "wrapper_config")
    if wrapper:
        settings = {**settings, "num_workers": wrapper.get("num_workers"), "query_timeout_sec": wrapper.get("query_timeout_sec")}
    known = None
    if get("known_translations"):
        if not get("known_translations", "result_count"):
            raise ProfileError("'known_translations' needs 'result_count'")
        known = KnownPairs(
            engine=get("known_translations", "target_engine"),
            embedding=get("known_translations", "embedding_function"),
            count=get("known_translations", "result_count"),
            user_request=get("known_translations", "user_request"),
            assistant_response=get("known_translations", "assistant_response"),
        )
    target = get("target") or {}
    return Profile(
        prompts=dict(get("prompts") or {}),
        provider=model.get("class"),
        provider_settings=settings,
        limit=settings.get("max_tokens") or settings.get("context_length"),
        ignore=list(get("source", "ignore_locations") or []),
        directives_to_comments=bool(get("source", "csharp", "convert_macros_to_comments")),
        tabs_to_spaces=bool(target.get("convert_tabs_to_spaces")),
        spaces_to_tabs=bool(target.get("convert_spaces_to_tabs")),
        camel_case_names=bool(target.get("convert_filename_to_camelcase")),
        snake_case_names=bool(target.get("convert_filename_to_snake_case")),
        lower_folders=bool(target.get("lower_folder_names")),
        extension=target.get("extension") or "",
        header_extension=target.get("header_extension") or "",
        implementation_extension=target.get("implementation_extension") or "",
        known=known,
        strategies=dict(get("strategies") or {}),
    )


def load_profile(name: str) -> Profile:
    """A shipped profile by name, or one from a YAML file by path."""
    if name.endswith((".yaml", ".yml")):
        import yaml

        with open(name, encoding="utf-8") as f:
            return from_config(yaml.safe_load(f))
    if name not in PROFILES:
        raise ProfileError(f"'{name}' is not a supported profile; there are: {', '.join(PROFILES)}")
    return from_config(PROFILES[name])
