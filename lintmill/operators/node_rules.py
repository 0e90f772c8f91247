"""Rules that one row of ``nodes`` decides, as a table of selectors and Columns.

All enabled ones run in a single scan: their tests are one array expression that is exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators.selectors import parse_selector, row_test


@dataclass(frozen=True)
class NodeRule:
    name: str
    category: str
    message: str
    selector: str
    extra: str | None = None  # SQL over the node's row
    languages: str = "all"

    def test(self) -> Column:
        test = F.lit(False)
        for member in parse_selector(self.selector):
            test |= row_test(member)
        return test & F.expr(self.extra) if self.extra else test


def _global(name: str) -> str:
    return f'CallExpression[callee.name="{name}"], NewExpression[callee.name="{name}"]'


_EQ = 'BinaryExpression[operator=/^[!=]==?$/]'
_COMPARE = 'BinaryExpression[operator=/^(?:[!=]==?|[<>]=?)$/]'
_NAN = ('[{0}.name="NaN"]', '[{0}.object.name="Number"][{0}.property.name="NaN"]')

#: name | category | message | selector [| extra SQL [| language]]
_TABLE: list[tuple] = [
    # correctness
    ("no-debugger", "correctness", "Unexpected 'debugger' statement.", "DebuggerStatement"),
    ("no-async-promise-executor", "correctness", "Promise executor functions should not be async.", 'NewExpression[callee.name="Promise"][arguments.0.async="true"]'),
    ("no-buffer-constructor", "correctness", "Buffer() is deprecated. Use Buffer.from(), Buffer.alloc(), or Buffer.allocUnsafe() instead.", _global("Buffer")),
    ("no-compare-neg-zero", "correctness", "Do not use the '{{operator}}' operator to compare against -0.", f'{_COMPARE}[right.operator="-"][right.argument.raw="0"], {_COMPARE}[left.operator="-"][left.argument.raw="0"]'),
    ("no-constant-condition", "correctness", "Unexpected constant condition.", 'IfStatement[test.type=/^(?:Literal|ArrayExpression|ObjectExpression|ArrowFunctionExpression|FunctionExpression|ClassExpression)$/], ConditionalExpression[test.type=/^(?:Literal|ArrayExpression|ObjectExpression|ArrowFunctionExpression|FunctionExpression)$/], WhileStatement[test.type=/^(?:Literal|ArrayExpression|ObjectExpression)$/], DoWhileStatement[test.type=/^(?:Literal|ArrayExpression|ObjectExpression)$/], ForStatement[test.type=/^(?:Literal|ArrayExpression|ObjectExpression)$/]'),
    ("no-empty-pattern", "correctness", "Unexpected empty pattern.", 'ObjectPattern[properties.length="0"], ArrayPattern[elements.length="0"]'),
    ("no-extra-semi", "correctness", "Unnecessary semicolon.", "EmptyStatement", "parent_type not in ('ForStatement','ForInStatement','ForOfStatement','WhileStatement','DoWhileStatement','IfStatement','LabeledStatement','WithStatement')"),
    ("no-invalid-remove-event-listener", "correctness", "The listener argument should be a function reference.", 'CallExpression[callee.property.name="removeEventListener"][arguments.1.type=/^(?:FunctionExpression|ArrowFunctionExpression)$/], CallExpression[callee.property.name="removeEventListener"][arguments.1.callee.property.name="bind"]'),
    ("no-loss-of-precision", "correctness", "This number literal will lose precision at runtime.", 'Literal[literal="number"][raw=/^[1-9]\\d{16,}$/]', "cast(cast(attrs['raw'] as double) as decimal(38,0)) <> cast(attrs['raw'] as decimal(38,0))"),
    ("no-negated-in-lhs", "correctness", "The 'in' expression's left operand is negated.", 'BinaryExpression[operator="in"][left.operator="!"]:not([left.parenthesized="true"])'),
    ("no-new-native-nonconstructor", "correctness", "`{{callee.name}}` cannot be called as a constructor.", 'NewExpression[callee.name=/^(?:Symbol|BigInt)$/]'),
    ("no-new-statics", "correctness", "Use `{{callee.object.name}}.{{callee.property.name}}()` without new.", 'NewExpression[callee.object.name="Promise"][callee.property.name=/^(?:resolve|reject|all|race|any|allSettled|withResolvers)$/]'),
    ("no-new-symbol", "correctness", "`Symbol` cannot be called as a constructor.", 'NewExpression[callee.name="Symbol"]'),
    ("no-obj-calls", "correctness", "'{{callee.name}}' is not a function.", 'CallExpression[callee.name=/^(?:Math|JSON|Reflect|Atomics|Intl)$/], NewExpression[callee.name=/^(?:Math|JSON|Reflect|Atomics|Intl)$/]'),
    ("no-prototype-builtins", "correctness", "Do not access Object.prototype method '{{callee.property.name}}' from target object.", 'CallExpression[callee.type="MemberExpression"][callee.property.name=/^(?:hasOwnProperty|isPrototypeOf|propertyIsEnumerable)$/]'),
    ("no-self-assign", "correctness", "'{{left.text}}' is assigned to itself.", 'AssignmentExpression[operator=/^(?:=|&&=|\\|\\|=|\\?\\?=)$/][left.type=/^(?:Identifier|MemberExpression)$/]', "attrs['left.text'] = attrs['right.text'] and attrs['left.text'] not like '%(%'"),
    ("no-sparse-arrays", "correctness", "Unexpected comma in middle of array.", "ArrayExpression[elements.holes]"),
    ("no-template-curly-in-string", "correctness", "Unexpected template string expression.", 'Literal[literal="string"][value=/\\$\\{[^}]+\\}/]'),
    ("no-unsafe-negation", "correctness", "Unexpected negating the left operand of '{{operator}}' operator.", 'BinaryExpression[operator=/^(?:in|instanceof)$/][left.operator="!"]:not([left.parenthesized="true"])'),
    ("no-unsafe-optional-chaining", "correctness", "Unsafe usage of optional chaining.", 'MemberExpression[object.type="ChainExpression"][object.parenthesized="true"][optional="false"], CallExpression[callee.type="ChainExpression"][callee.parenthesized="true"][optional="false"], NewExpression[callee.type="ChainExpression"], SpreadElement[argument.type="ChainExpression"], BinaryExpression[operator=/^(?:in|instanceof)$/][right.type="ChainExpression"], ClassDeclaration[superClass.type="ChainExpression"]'),
    ("no-useless-rename", "correctness", "{{text}} is a useless rename.", "ImportSpecifier, ExportSpecifier", "attrs['text'] like '% as %' and coalesce(attrs['imported.name'], attrs['exported.name']) = attrs['local.name']"),
    ("prefer-exponentiation-operator", "correctness", "Use the '**' operator instead of 'Math.pow'.", 'CallExpression[callee.object.name="Math"][callee.property.name="pow"]'),
    ("use-isnan", "correctness", "Use the isNaN function to compare with NaN.", ", ".join([f"{_COMPARE}{n.format(side)}" for side in ("left", "right") for n in _NAN] + [f"SwitchStatement{n.format('discriminant')}" for n in _NAN] + [f"SwitchCase{n.format('test')}" for n in _NAN] + ['CallExpression[callee.property.name=/^(?:indexOf|lastIndexOf)$/][arguments.0.name="NaN"]'])),
    ("valid-typeof", "correctness", "Invalid typeof comparison value.", ", ".join(f'{_EQ}[{a}.operator="typeof"][{b}.literal="string"]:not([{b}.value=/^(?:undefined|object|boolean|number|string|function|symbol|bigint)$/])' for a, b in (("left", "right"), ("right", "left")))),
    # suspicious
    ("eqeqeq", "suspicious", "Expected '{{operator}}=' and instead saw '{{operator}}'.", "BinaryExpression[operator=/^[!=]=$/]"),
    ("no-alert", "suspicious", "Unexpected {{callee.text}}.", 'CallExpression[callee.name=/^(?:alert|confirm|prompt)$/], CallExpression[callee.object.name=/^(?:window|globalThis)$/][callee.property.name=/^(?:alert|confirm|prompt)$/]'),
    ("no-case-declarations", "suspicious", "Unexpected lexical declaration in case block.", "SwitchCase > VariableDeclaration[kind=/^(?:let|const)$/], SwitchCase > FunctionDeclaration, SwitchCase > ClassDeclaration", "slot = 'consequent'"),
    ("no-cond-assign", "suspicious", "Expected a conditional expression and instead saw an assignment.", ", ".join(f'{t} > AssignmentExpression.test:not([parenthesized="true"])' for t in ("IfStatement", "WhileStatement", "DoWhileStatement", "ForStatement", "ConditionalExpression"))),
    ("no-console", "suspicious", "Unexpected console statement.", 'MemberExpression[object.name="console"]'),
    ("no-control-regex", "suspicious", "Unexpected control character(s) in regular expression.", 'Literal[literal="regex"][regex_pattern=/\\\\x[01][0-9a-fA-F]|\\\\u00[01][0-9a-fA-F]|[\\x00-\\x1f]/]'),
    ("no-delete-var", "suspicious", "Variables should not be deleted.", 'UnaryExpression[operator="delete"][argument.type="Identifier"]'),
    ("no-empty-character-class", "suspicious", "Empty class.", 'Literal[literal="regex"][regex_pattern=/(?:^|[^\\\\\\[])\\[\\]/]'),
    ("no-eval", "suspicious", "`eval` can be harmful.", 'CallExpression[callee.name="eval"], CallExpression[callee.property.name="eval"][callee.object.name=/^(?:window|global|globalThis)$/], CallExpression[callee.property.name="eval"][callee.object.type="ThisExpression"]'),
    ("no-implied-eval", "suspicious", "Implied eval. Consider passing a function instead of a string.", 'CallExpression[callee.name=/^(?:setTimeout|setInterval|execScript)$/][arguments.0.type=/^(?:Literal|TemplateLiteral)$/]', "coalesce(attrs['arguments.0.literal'], 'string') = 'string'"),
    ("no-lone-blocks", "suspicious", "Nested block is redundant.", "BlockStatement > BlockStatement, Program > BlockStatement, StaticBlock > BlockStatement"),
    ("no-multi-str", "suspicious", "Multiline support is limited to browsers supporting ES5 only.", 'Literal[literal="string"][raw=/\\n/]', "parent_type not like 'JSX%'"),
    ("no-new-wrappers", "suspicious", "Do not use {{callee.name}} as a constructor.", "NewExpression[callee.name=/^(?:String|Number|Boolean)$/]"),
    ("no-nonoctal-decimal-escape", "suspicious", "Don't use '\\8' and '\\9'.", 'Literal[literal="string"][raw=/^(?:[^\\\\]|\\\\[^89])*\\\\[89]/]'),
    ("no-object-constructor", "suspicious", "The object literal notation {} is preferable.", 'CallExpression[callee.name="Object"][arguments.length="0"], NewExpression[callee.name="Object"][arguments.length="0"]'),
    ("no-octal-escape", "suspicious", "Don't use octal escapes.", 'Literal[literal="string"][raw=/^(?:[^\\\\]|\\\\[^0-7])*\\\\(?:[1-7]|0[0-9])/]'),
    ("no-process-exit", "suspicious", "Don't use process.exit(); throw an error instead.", 'CallExpression[callee.object.name="process"][callee.property.name="exit"]'),
    ("no-regex-spaces", "suspicious", "Spaces are hard to count. Use a quantifier.", 'Literal[literal="regex"][regex_pattern=/^(?:[^\\[]|\\[[^\\]]*\\])*? {2,}/]'),
    ("no-script-url", "suspicious", "Script URL is a form of eval.", 'Literal[literal="string"][value=/^javascript:/i]'),
    ("no-self-compare", "suspicious", "Comparing to itself is potentially pointless.", _COMPARE, "attrs['left.text'] = attrs['right.text']"),
    ("no-sequences", "suspicious", "Unexpected use of comma operator.", 'SequenceExpression:not([parenthesized="true"])', "not (parent_type = 'ForStatement' and slot in ('init','update'))"),
    ("no-throw-literal", "suspicious", "Expected an error object to be thrown.", "ThrowStatement[argument.type=/^(?:Literal|TemplateLiteral|ObjectExpression|ArrayExpression|BinaryExpression|UnaryExpression|ArrowFunctionExpression|FunctionExpression)$/], ThrowStatement[argument.name=/^undefined$/]"),
    ("no-undefined", "suspicious", "Unexpected use of undefined.", 'Identifier[name="undefined"]', "slot not in ('property','key')"),
    ("no-void", "suspicious", "Expected 'undefined' and instead saw 'void'.", 'UnaryExpression[operator="void"]'),
    ("no-with", "suspicious", "Unexpected use of 'with' statement.", "WithStatement"),
    ("radix", "suspicious", "Missing radix parameter.", 'CallExpression[callee.name="parseInt"][arguments.length="1"], CallExpression[callee.object.name="Number"][callee.property.name="parseInt"][arguments.length="1"]'),
    # style
    ("arrow-parens", "style", "Expected parentheses around arrow function argument.", 'ArrowFunctionExpression[params.length="1"][params.0.type="Identifier"][head=/^(?:async )?[^( ]+ =>/]'),
    ("arrow-body-style", "style", "Unexpected block statement surrounding arrow body.", 'ArrowFunctionExpression[body.type="BlockStatement"][body.body.length="1"][body.body.0.type="ReturnStatement"]'),
    ("avoid-new", "style", "Avoid creating new promises.", 'NewExpression[callee.name="Promise"]'),
    ("camelcase", "style", "Identifier '{{name}}' is not in camel case.", "Identifier[name=/^_*[^_]+_+[^_]/]", "upper(attrs['name']) <> attrs['name'] and slot in ('id','params','local','left','param') and parent_type not like 'TS%'"),
    ("consistent-date-clone", "style", "Unnecessary `.getTime()` call.", 'NewExpression[callee.name="Date"][arguments.length="1"][arguments.0.callee.property.name="getTime"]'),
    ("curly", "style", "Expected { after condition.", 'IfStatement[consequent.type]:not([consequent.type="BlockStatement"]), WhileStatement[body.type]:not([body.type="BlockStatement"]), ForStatement[body.type]:not([body.type="BlockStatement"])'),
    ("dot-notation", "style", "[{{property.raw}}] is better written in dot notation.", 'MemberExpression[computed="true"][property.literal="string"][property.value=/^[a-zA-Z_$][\\w$]*$/]'),
    ("error-message", "style", "Pass a message to the `{{callee.name}}` constructor.", 'NewExpression[callee.name=/^(?:Error|TypeError|RangeError|SyntaxError|EvalError|ReferenceError|URIError)$/][arguments.length="0"]'),
    ("func-names", "style", "Unexpected unnamed function.", "FunctionExpression:not([id.type])", "parent_type not in ('MethodDefinition','Property','VariableDeclarator','PropertyDefinition','AssignmentPattern') and not (parent_type = 'AssignmentExpression' and slot = 'right')"),
    ("func-style", "style", "Expected a function expression.", "FunctionDeclaration", "parent_type not like 'Export%'"),
    ("guard-for-in", "style", "The body of a for-in should be wrapped in an if statement.", 'ForInStatement:not([body.type=/^(?:IfStatement|EmptyStatement)$/]):not([body.body.0.type="IfStatement"]):not([body.body.length="0"])'),
    ("id-length", "style", "Identifier name '{{name}}' is too short (< 2).", "Identifier[name=/^.$/]", "slot in ('id','params','local','param')"),
    ("max-params", "style", "Function has too many parameters. Maximum allowed is 3.", ":function[params.length>3]"),
    ("new-cap", "style", "A constructor name should not start with a lowercase letter.", "NewExpression[callee.name=/^[a-z]/]"),
    ("new-parens", "style", "Missing '()' invoking a constructor.", 'NewExpression[hasParens="false"]'),
    ("no-array-constructor", "style", "The array literal notation [] is preferable.", 'CallExpression[callee.name="Array"]:not([arguments.length="1"]), NewExpression[callee.name="Array"]:not([arguments.length="1"])'),
    ("no-array-for-each", "style", "Use `for…of` instead of `.forEach(…)`.", 'CallExpression[callee.property.name="forEach"]'),
    ("no-bitwise", "style", "Unexpected use of '{{operator}}'.", 'BinaryExpression[operator=/^(?:[&|^]|<<|>>>?)$/], AssignmentExpression[operator=/^(?:[&|^]|<<|>>>?)=$/], UnaryExpression[operator="~"]'),
    ("no-caller", "style", "Avoid arguments.{{property.name}}.", 'MemberExpression[object.name="arguments"][property.name=/^(?:callee|caller)$/]'),
    ("no-confusing-arrow", "style", "Arrow function used ambiguously with a conditional expression.", 'ArrowFunctionExpression[body.type="ConditionalExpression"]:not([body.parenthesized="true"])'),
    ("no-continue", "style", "Unexpected use of continue statement.", "ContinueStatement"),
    ("no-div-regex", "style", "A regular expression literal can be confused with '/='.", 'Literal[literal="regex"][regex_pattern=/^=/]'),
    ("no-eq-null", "style", "Use '===' to compare with null.", 'BinaryExpression[operator=/^[!=]=$/][right.raw="null"], BinaryExpression[operator=/^[!=]=$/][left.raw="null"]'),
    ("no-extend-native", "style", "{{left.object.object.name}} prototype is read only, properties should not be added.", 'AssignmentExpression[left.object.property.name="prototype"][left.object.object.name=/^(?:Object|Function|Array|String|Number|Boolean|Date|RegExp|Promise|Map|Set|Symbol|Error)$/]'),
    ("no-extra-boolean-cast", "style", "Redundant double negation.", ", ".join(f'{t} > UnaryExpression.test[operator="!"][argument.operator="!"]' for t in ("IfStatement", "WhileStatement", "DoWhileStatement", "ForStatement", "ConditionalExpression")) + ', UnaryExpression[operator="!"][argument.operator="!"][argument.argument.operator="!"]'),
    ("no-floating-decimal", "style", "A decimal point should have digits on both sides.", 'Literal[literal="number"][raw=/^\\.|\\.$/]'),
    ("no-implicit-coercion", "style", "Use an explicit conversion.", 'UnaryExpression[operator="!"][argument.operator="!"], UnaryExpression[operator="+"]:not([argument.type="Literal"]), BinaryExpression[operator="+"][left.value=""][left.literal="string"], BinaryExpression[operator="+"][right.value=""][right.literal="string"], BinaryExpression[operator="*"][right.raw="1"]'),
    ("no-iterator", "style", "Reserved name '__iterator__'.", 'MemberExpression[property.name="__iterator__"], MemberExpression[property.value="__iterator__"]'),
    ("no-labels", "style", "Unexpected labeled statement.", "LabeledStatement, BreakStatement[label.type], ContinueStatement[label.type]"),
    ("no-multi-assign", "style", "Unexpected chained assignment.", "VariableDeclarator > AssignmentExpression.init, AssignmentExpression > AssignmentExpression.right, PropertyDefinition > AssignmentExpression.value"),
    ("no-negated-condition", "style", "Unexpected negated condition.", 'IfStatement[alternate.type][test.operator=/^(?:!|!==?)$/]:not([alternate.type="IfStatement"]), ConditionalExpression[test.operator=/^(?:!|!==?)$/]'),
    ("no-negation-in-equality-check", "style", "Negated expression is not allowed in equality check.", f'{_EQ}[left.operator="!"]:not([left.parenthesized="true"]):not([left.argument.operator="!"])'),
    ("no-nested-ternary", "style", "Do not nest ternary expressions.", 'ConditionalExpression[consequent.type="ConditionalExpression"], ConditionalExpression[alternate.type="ConditionalExpression"]'),
    ("no-new", "style", "Do not use 'new' for side effects.", "ExpressionStatement > NewExpression"),
    ("no-new-func", "style", "The Function constructor is eval.", _global("Function") + ', CallExpression[callee.object.name="Function"][callee.property.name=/^(?:call|apply|bind)$/]'),
    ("no-new-object", "style", "The object literal notation {} is preferable.", 'NewExpression[callee.name="Object"]'),
    ("no-new-require", "style", "Unexpected use of new with require.", 'NewExpression[callee.name="require"], NewExpression[callee.callee.name="require"]'),
    ("no-octal", "style", "Octal literals should not be used.", 'Literal[literal="number"][raw=/^0[0-9]/]'),
    ("no-path-concat", "style", "Use path.join() or path.resolve() instead of string concatenation.", 'BinaryExpression[operator="+"][left.name=/^__(?:dir|file)name$/], BinaryExpression[operator="+"][right.name=/^__(?:dir|file)name$/]'),
    ("no-plusplus", "style", "Unary operator '{{operator}}' used.", "UpdateExpression"),
    ("no-process-env", "style", "Unexpected use of process.env.", 'MemberExpression[object.name="process"][property.name="env"]'),
    ("no-proto", "style", "The '__proto__' property is deprecated.", 'MemberExpression[property.name="__proto__"], MemberExpression[property.value="__proto__"]'),
    ("no-return-assign", "style", "Return statement should not contain assignment.", 'ReturnStatement > AssignmentExpression.argument:not([parenthesized="true"]), ArrowFunctionExpression > AssignmentExpression.body:not([parenthesized="true"])'),
    ("no-static-only-class", "style", "Use an object instead of a class with only static members.", 'ClassBody[body.length="1"][body.0.static="true"]'),
    ("no-ternary", "style", "Ternary operator used.", "ConditionalExpression"),
    ("no-this-assignment", "style", "Do not assign `this` to `{{id.name}}`.", 'VariableDeclarator[init.type="ThisExpression"][id.type="Identifier"]'),
    ("no-undef-init", "style", "It's not necessary to initialize '{{id.name}}' to undefined.", 'VariableDeclarator[init.name=/^undefined$/][id.type="Identifier"]'),
    ("no-underscore-dangle", "style", "Unexpected dangling '_' in '{{name}}'.", "Identifier[name=/^_.|._$/]", "slot in ('id','params','property')"),
    ("no-unnecessary-array-flat-depth", "style", "Passing `1` as the `depth` argument is unnecessary.", 'CallExpression[callee.property.name="flat"][arguments.length="1"][arguments.0.raw="1"]'),
    ("no-unneeded-ternary", "style", "Unnecessary use of boolean literals in conditional expression.", 'ConditionalExpression[consequent.literal="boolean"][alternate.literal="boolean"]'),
    ("no-useless-call", "style", "Unnecessary '.{{callee.property.name}}()'.", 'CallExpression[callee.property.name=/^(?:call|apply)$/][callee.object.type="Identifier"][arguments.0.raw="null"], CallExpression[callee.property.name=/^(?:call|apply)$/][callee.object.type="Identifier"][arguments.0.name=/^undefined$/]'),
    ("no-useless-computed-key", "style", "Unnecessarily computed property {{key.raw}} found.", 'Property[computed="true"][key.type="Literal"], MethodDefinition[computed="true"][key.type="Literal"], PropertyDefinition[computed="true"][key.type="Literal"]'),
    ("no-useless-concat", "style", "Unexpected string concatenation of literals.", 'BinaryExpression[operator="+"][left.literal="string"][right.literal="string"]', "line = end_line"),
    ("no-var", "style", "Unexpected var, use let or const instead.", 'VariableDeclaration[kind="var"]:not([declare="true"])'),
    ("no-zero-fractions", "style", "Don't use a zero fraction in the number.", 'Literal[literal="number"][raw=/^\\d+\\.(?:0*|\\d*0)$/]'),
    ("object-shorthand", "style", "Expected property shorthand.", 'Property[shorthand="false"][method="false"][kind="init"][computed="false"]', "attrs['value.name'] = attrs['key.name'] or attrs['value.type'] = 'FunctionExpression' and attrs['value.id.type'] is null"),
    ("prefer-array-flat-map", "style", "Prefer `.flatMap(…)` over `.map(…).flat()`.", 'CallExpression[callee.property.name="flat"][arguments.length="0"][callee.object.callee.property.name="map"]'),
    ("prefer-array-some", "style", "Prefer `.some(…)` over `.filter(…).length`.", 'BinaryExpression[left.property.name="length"][left.object.callee.property.name="filter"][right.raw="0"]'),
    ("prefer-blob-reading-methods", "style", "Prefer Blob methods over FileReader.", 'CallExpression[callee.property.name=/^readAs(?:Text|ArrayBuffer)$/]'),
    ("prefer-dom-node-append", "style", "Prefer `Node#append()` over `Node#appendChild()`.", 'CallExpression[callee.property.name="appendChild"][arguments.length="1"]'),
    ("prefer-math-min-max", "style", "Prefer `Math.min()` or `Math.max()`.", 'ConditionalExpression[test.operator=/^[<>]=?$/]', "(attrs['test.left.name'] = attrs['consequent.name'] and attrs['test.right.name'] = attrs['alternate.name']) or (attrs['test.left.name'] = attrs['alternate.name'] and attrs['test.right.name'] = attrs['consequent.name'])"),
    ("prefer-node-protocol", "style", "Prefer `node:{{source.value}}` over `{{source.value}}`.", 'ImportDeclaration[source.value=/^(?:fs|path|os|http|https|crypto|stream|util|url|events|child_process|buffer|zlib|net|assert|process)$/]'),
    ("prefer-numeric-literals", "style", "Use a literal instead of parseInt().", 'CallExpression[callee.name="parseInt"][arguments.length="2"][arguments.0.literal="string"][arguments.1.raw=/^(?:2|8|16)$/]'),
    ("prefer-object-has-own", "style", "Use 'Object.hasOwn()' instead.", 'CallExpression[callee.property.name="call"][callee.object.property.name="hasOwnProperty"]'),
    ("prefer-object-spread", "style", "Use an object spread instead of `Object.assign`.", 'CallExpression[callee.object.name="Object"][callee.property.name="assign"][arguments.0.type="ObjectExpression"]'),
    ("prefer-regex-literals", "style", "Use a regular expression literal.", 'CallExpression[callee.name="RegExp"][arguments.0.literal="string"], NewExpression[callee.name="RegExp"][arguments.0.literal="string"]'),
    ("prefer-response-static-json", "style", "Prefer `Response.json(…)`.", 'NewExpression[callee.name="Response"][arguments.0.callee.object.name="JSON"][arguments.0.callee.property.name="stringify"]'),
    ("prefer-spread", "style", "Use the spread operator instead of '.apply()'.", 'CallExpression[callee.property.name="apply"][arguments.length="2"]', "attrs['arguments.0.raw'] = 'null' or attrs['arguments.0.name'] in ('undefined', attrs['callee.object.object.name'])"),
    ("prefer-string-trim-start-end", "style", "Prefer `String#trimStart()` or `String#trimEnd()`.", 'CallExpression[callee.property.name=/^trim(?:Left|Right)$/][arguments.length="0"]'),
    ("prefer-template", "style", "Unexpected string concatenation.", 'BinaryExpression[operator="+"][left.literal="string"]:not([right.literal="string"]), BinaryExpression[operator="+"][right.literal="string"]:not([left.literal="string"])', "parent_type <> 'BinaryExpression'"),
    ("require-number-to-fixed-digits-argument", "style", "Missing the digits argument.", 'CallExpression[callee.property.name="toFixed"][arguments.length="0"]'),
    ("require-unicode-regexp", "style", "Use the 'u' flag.", 'Literal[literal="regex"]:not([regex_flags=/[uv]/])'),
    ("symbol-description", "style", "Expected Symbol to have a description.", 'CallExpression[callee.name="Symbol"][arguments.length="0"]'),
    ("throw-new-error", "style", "Use `new` when creating an error.", 'ThrowStatement[argument.type="CallExpression"][argument.callee.name=/^(?:[A-Z][a-z\\d]*)*Error$/]'),
    ("wrap-regex", "style", "Wrap the regexp literal in parens to disambiguate the slash.", 'MemberExpression > Literal.object[literal="regex"]:not([parenthesized="true"])'),
    ("yoda", "style", "Expected literal to be on the right side of {{operator}}.", f'{_COMPARE}[left.type="Literal"]:not([right.type="Literal"])'),
    # typescript
    ("no-explicit-any", "typescript", "Unexpected any. Specify a different type.", "TSAnyKeyword", None, "ts"),
    ("no-non-null-assertion", "typescript", "Forbidden non-null assertion.", "TSNonNullExpression", None, "ts"),
    ("no-extra-non-null-assertion", "typescript", "Forbidden extra non-null assertion.", "TSNonNullExpression > TSNonNullExpression", None, "ts"),
    ("no-non-null-asserted-optional-chain", "typescript", "Optional chain expressions can return undefined by design.", 'TSNonNullExpression[expression.type="ChainExpression"]', None, "ts"),
    ("no-non-null-asserted-nullish-coalescing", "typescript", "The nullish coalescing operator is designed to handle undefined and null.", 'LogicalExpression[operator="??"][left.type="TSNonNullExpression"]', None, "ts"),
    ("no-confusing-non-null-assertion", "typescript", "Confusing combination of non-null assertion and equality test.", 'BinaryExpression[operator=/^==?=?$/][left.type="TSNonNullExpression"], AssignmentExpression[operator="="][left.type="TSNonNullExpression"]', None, "ts"),
    ("no-namespace", "typescript", "ES2015 module syntax is preferred over namespaces.", 'TSModuleDeclaration[kind=/^(?:namespace|module)$/]:not([declare="true"])', None, "ts"),
    ("prefer-namespace-keyword", "typescript", "Use 'namespace' instead of 'module'.", 'TSModuleDeclaration[kind="module"][id.type="Identifier"]', None, "ts"),
    ("no-empty-interface", "typescript", "An empty interface is equivalent to `{}`.", 'TSInterfaceDeclaration[body.body.length="0"]', "cast(attrs['extends.length'] as int) < 2", "ts"),
    ("no-empty-object-type", "typescript", "The `{}` type allows any non-nullish value.", 'TSTypeLiteral[members.length="0"]', "parent_type not in ('TSIntersectionType')", "ts"),
    ("array-type", "typescript", "Array type using 'Array<T>' is forbidden.", 'TSTypeReference[typeName.name=/^(?:Readonly)?Array$/]', None, "ts"),
    ("consistent-type-definitions", "typescript", "Use an `interface` instead of a `type`.", 'TSTypeAliasDeclaration[typeAnnotation.type="TSTypeLiteral"]', None, "ts"),
    ("consistent-type-assertions", "typescript", "Use 'as T' instead of '<T>'.", "TSTypeAssertion", None, "ts"),
    ("consistent-indexed-object-style", "typescript", "A record is preferred over an index signature.", 'TSInterfaceBody[body.length="1"][body.0.type="TSIndexSignature"], TSTypeLiteral[members.length="1"] > TSIndexSignature', None, "ts"),
    ("explicit-member-accessibility", "typescript", "Missing accessibility modifier.", "MethodDefinition:not([accessibility]), PropertyDefinition:not([accessibility])", "coalesce(attrs['key.type'], '') <> 'PrivateIdentifier'", "ts"),
    ("method-signature-style", "typescript", "Shorthand method signature is forbidden. Use a function property instead.", 'TSMethodSignature[kind="method"]', None, "ts"),
    ("no-require-imports", "typescript", "A `require()` style import is forbidden.", 'CallExpression[callee.name="require"], TSImportEqualsDeclaration[moduleReference.callee.name="require"]'),
    ("no-var-requires", "typescript", "Require statement not part of import statement.", 'VariableDeclarator[init.type="CallExpression"][init.callee.name="require"]'),
    ("no-this-alias", "typescript", "Unexpected aliasing of 'this' to local variable.", 'VariableDeclarator[init.type="ThisExpression"][id.type="Identifier"]'),
    ("no-array-delete", "typescript", "Using the `delete` operator with an array expression is unsafe.", 'UnaryExpression[operator="delete"][argument.computed="true"][argument.property.literal="number"]'),
    ("no-dynamic-delete", "typescript", "Do not delete dynamically computed property keys.", 'UnaryExpression[operator="delete"][argument.computed="true"]:not([argument.property.type="Literal"])'),
    ("no-inferrable-types", "typescript", "Type trivially inferred from a literal, remove type annotation.", 'VariableDeclarator[id.typeAnnotation.typeAnnotation.type="TSStringKeyword"][init.literal="string"], VariableDeclarator[id.typeAnnotation.typeAnnotation.type="TSNumberKeyword"][init.literal="number"], VariableDeclarator[id.typeAnnotation.typeAnnotation.type="TSBooleanKeyword"][init.literal="boolean"]', None, "ts"),
    ("no-unnecessary-type-constraint", "typescript", "Constraining the generic type to `any` or `unknown` does nothing.", 'TSTypeParameter[constraint.type=/^TS(?:Any|Unknown)Keyword$/]', None, "ts"),
    ("no-unsafe-function-type", "typescript", "The `Function` type accepts any function-like value.", 'TSTypeReference[typeName.name="Function"]', None, "ts"),
    ("no-wrapper-object-types", "typescript", "Prefer using the primitive `{{typeName.name}}`.", 'TSTypeReference[typeName.name=/^(?:String|Number|Boolean|Object|Symbol|BigInt)$/]', None, "ts"),
    ("no-import-type-side-effects", "typescript", "Use a top-level type qualifier for inline type specifiers.", 'ImportDeclaration[importKind="value"][text=/^import \\{ (?:type \\w+(?: as \\w+)? ?,? ?)+\\} from/]', None, "ts"),
    ("parameter-properties", "typescript", "Property should be declared as a class property.", "TSParameterProperty", None, "ts"),
    ("prefer-as-const", "typescript", "Expected a `const` instead of a literal type assertion.", 'TSAsExpression[expression.type="Literal"][typeAnnotation.type="TSLiteralType"]', "attrs['expression.raw'] = attrs['typeAnnotation.literal.raw']", "ts"),
    ("prefer-enum-initializers", "typescript", "The value of the member should be explicitly defined.", "TSEnumMember:not([initializer.type])", None, "ts"),
    ("prefer-literal-enum-member", "typescript", "Explicit enum value must only be a literal value.", "TSEnumMember[initializer.type]:not([initializer.type=/^(?:Literal|TemplateLiteral|UnaryExpression)$/])", None, "ts"),
    ("prefer-function-type", "typescript", "Interface only has a call signature, use a function type instead.", 'TSInterfaceBody[body.length="1"][body.0.type="TSCallSignatureDeclaration"], TSTypeLiteral[members.length="1"] > TSCallSignatureDeclaration', None, "ts"),
    ("no-misused-new", "typescript", "Interfaces cannot be constructed, only classes.", 'TSInterfaceBody > TSMethodSignature[key.name="constructor"]', None, "ts"),
    ("prefer-reduce-type-parameter", "typescript", "Unnecessary assertion, use the type parameter instead.", 'CallExpression[callee.property.name="reduce"][arguments.1.type="TSAsExpression"]', None, "ts"),
    ("no-useless-empty-export", "typescript", "Empty export does nothing.", 'ExportNamedDeclaration[specifiers.length="0"]:not([declaration.type]):not([source.type])', None, "ts"),
    ("no-mixed-types-in-rest", "typescript", "Rest element of type any.", 'RestElement[typeAnnotation.typeAnnotation.type="TSAnyKeyword"]', None, "ts"),
]

RULES = {row[0]: NodeRule(*row) for row in _TABLE if row[0] != "no-mixed-types-in-rest"}


def _member_type(member) -> str | None:
    while hasattr(member, "right"):
        member = member.right
    return member.type


def _tests_by_type(rules: list[NodeRule]) -> dict[str | None, list[Column]]:
    """For each node type the tests that can hold for it: the rule's name or null. None holds those for any type."""
    out: dict[str | None, list[Column]] = {}
    for r in rules:
        members: dict[str | None, Column] = {}
        for m in parse_selector(r.selector):
            kind = _member_type(m)
            members[kind] = row_test(m) if kind not in members else members[kind] | row_test(m)
        for kind, test in members.items():
            out.setdefault(kind, []).append(F.when(test & F.expr(r.extra) if r.extra else test, F.lit(r.name)))
    return out


def types_of(names: list[str]) -> frozenset[str] | None:
    """The node types that the named rules test; None if one tests any type."""
    kinds = {_member_type(m) for n in names for m in parse_selector(RULES[n].selector)}
    return None if None in kinds else frozenset(kinds)


def run_node_rules(nodes: DataFrame, names: list[str], language: str | None = None) -> DataFrame:
    """(path, rule, node_id, line, col, start, end, attrs) of every match of the named rules, in one scan.

    A node is tested only by the rules of its type.
    """
    rules = [RULES[n] for n in names if language is None or RULES[n].languages in ("all", language)]
    tests = _tests_by_type(rules)
    anywhere = tests.pop(None, [])
    hits = F.array(*anywhere).cast("array<string>") if anywhere else F.lit(None).cast("array<string>")
    chosen = F.when(F.lit(False), hits)
    for kind, own in tests.items():
        chosen = chosen.when(F.col("type") == kind, F.array(*own, *anywhere))
    found = F.array_distinct(F.filter(chosen.otherwise(hits), lambda x: x.isNotNull()))
    wanted = nodes if anywhere else nodes.where(F.col("type").isin(*tests))
    return wanted.select("path", F.explode(found).alias("rule"), "node_id", "line", "col", "start", "end", "attrs")
