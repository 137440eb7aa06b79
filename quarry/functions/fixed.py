"""Fixed values that must equal the reference pipeline's for equal results.

Everything in this module is data, not logic: prompt texts, whitelists,
thresholds and the agent/chapter map, kept in their natural order.
"""

# --- fixed values: chat-example validator ------------------------------------
ALLOWED_MESSAGE_KEYS = ("role", "content", "name", "function_call", "weight")
ALLOWED_ROLES = ("system", "user", "assistant", "function")
FORMAT_ERROR_KINDS = (
    "data_type",
    "missing_messages_list",
    "message_missing_key",
    "message_unrecognized_key",
    "unrecognized_role",
    "missing_content",
    "example_missing_assistant_message",
)

# --- fixed values: token budget and epoch heuristic --------------------------
MAX_TOKENS_PER_EXAMPLE = 16385
TARGET_EPOCHS = 3
MIN_TARGET_EXAMPLES = 100
MAX_TARGET_EXAMPLES = 25000
MIN_DEFAULT_EPOCHS = 1
MAX_DEFAULT_EPOCHS = 25
TOKENS_PER_MESSAGE = 3
TOKENS_PER_NAME = 1
TOKENS_PER_EXAMPLE = 3

# --- fixed values: splits -----------------------------------------------------
SPLIT_SEED = 196
TRAIN_FRACTION_TENTHS = 8          # 80/20 specialists and orchestrator
EARLY_TRAIN_FRACTION_TENTHS = 9    # 90/10 early example
CONTEXT_LENGTH_SMALL = 1024
CONTEXT_LENGTH_LARGE = 2048
LABEL_IGNORE = -100
RETRIEVAL_K = 3

# --- fixed values: agent -> chapters (trainer variant, no ch00) --------------
AGENT_CHAPTERS = {
    1: ["ch01", "ch02", "ch05", "ch06", "ch10", "ch11", "ch12", "ch13", "ch14", "ch15"],
    2: ["ch03", "ch04", "ch08", "ch09", "ch25", "ch26"],
    3: ["ch07", "ch16", "ch17", "ch18", "ch19", "ch20", "ch21", "ch22", "ch23", "ch24"],
}
AGENT_NAMES = {1: "first_agent", 2: "second_agent", 3: "third_agent"}
# orchestrator set of the trainer: every chapter ch01..ch26
ORCHESTRATOR_CHAPTERS = [f"ch{i:02d}" for i in range(1, 27)]

# --- fixed values: agent -> chapter numbers (notebook variant, 0-based, as published) --
AGENT_CHAPTER_NUMBERS_NOTEBOOK = {
    1: [0, 1, 5, 6, 10, 11, 12, 13, 14, 15],
    2: [3, 4, 8, 9, 25, 26],
    3: [7, 16, 27, 28, 29, 20, 21, 22, 23, 24],
}

# --- fixed values: prompt texts -------------------------------------------------
SYSTEM_PROMPT = """
You are a helpful assistant used for data processing. You have expert understanding of taking in
chunks of textual data and generating question answer pairs for supervised fine tuning. You do not incorporate your own knowledge
and only use factual information form the provided knowledge text."""

USER_PROMPT = """
I want to create question answer pairs for the following knowledge text. First identify all key facts in the knowledge text 
(there is no set number, knowledge text might be short or long, make sure facts you have identified are strong and comprehensively cover the text).

Next for each fact, propose all plausible questions a person might commonly ask a knowledgeable assitant, give answers grounded on the facts you have identified and knowledge text.
Generate questions that people will commonly ask about this the given knowledge base.
ake sure your answers to the questions are clear and comprehensive, the answers must simulate an expert clearly yet succintly provinding a factual answer.
Make your answers medium length, but do not leave out important information, cover nuances relating to the question.

   
follow this line of reasoning and formatting:
<example>
<example_knowledge_text>
1.035 Co-Owners (VC §§4150.5 and 9852.5)
A vehicle or vessel may be owned by two or more co-owners. Co-owner names may be joined by “and”, “and/or”, or “or”. All owners mustendorse the title or registration application to register the vehicle/vessel, but the requirements for releasing ownership vary. Refer to Chapter 11.
Certificates issued for applications not indicating “and” or “or” between the names will show “and” as represented by a slash (/) between the names.
* The signatures of all owners are required to transfer ownership when the co-owner names are joined by “and”. Ownership passes to the surviving co-owner upon the death of a co-owner or, with the surviving co-owner’s release, to a new owner. A deceased co-owner’s interest may only be released by one of the following:
   * Heir of the deceased with an Affidavit for Transfer Without Probate California Titled Vehicle or Vessels Only (REG 5) form.
   * Administrator with Letters of Administration.
   * Executor with Letters Testamentary.
* The signature of only one owner is required to transfer ownership when the co-owner names are joined by “and/or” or “or”. A surviving co-owner’s signature on the title releases all owners’ interest unless “Tenants in Common” or “COMPRO” follows the co-owner’s names.
* A REG 5 cannot be used to circumvent the interest of a surviving owner when the vehicles are jointly owned by two or more persons and one of the owners is deceased. However, the surviving owner (if they are the heir) may complete a REG 5 to release the interest of the deceased owner. The California Certificate of Title must be signed twice, once by surviving owner and once for the deceased owner countersigned by the heir. If owned jointly by two or more deceased owners, a REG 5 for the most recently deceased owner and a death certificate for each owner is required.
Tenants in Common—When “Tenants in Common” follows the names of co-owners, the interest of a deceased co-owner reverts to the deceased co-owner’s estate, not to the surviving co-owner. Ownership may be transferred with Letters Testamentary, Letters of Administration, or an Affidavit for Transfer Without Probate California Titled Vehicle or Vessels Only (REG 5) form.
COMPRO—When “COMPRO” (community property) follows the names of co-owners, ownership passes to the surviving owner after the deceased co-owner’s interest is executed by the:
* Heir of the deceased with a REG 5, if the estate was not probated.
* Administrator of the estate with Letters of Administration.
* Executor of the estate with Letters Testamentary.
Ownership may be transferred to a new owner with the surviving co-owner’s release.
JTRS—When “JTRS” (joint tenants with right of survivorship) follows the names of co-owners:
* All owners must release interest during the lifetime of the co-owners.
* Upon the death of an owner, interest is released by the surviving co-owner.
* A copy of the deceased owner’s death certificate must accompany the application.
* The signature of the surviving co-owner(s) on the title releases all owner interests.
TOD (Transfer on Death)—Refer to Chapter 11.
<end_example_knowledge_text>
<example_qa_pair>
FACT 1: A vehicle or vessel may be owned by two or more co-owners
[{{'role': 'user', 'content': 'Can I register a car to multiple users in California'}},
{{'role': 'assistant', 'content': 'Yes, you can register a car under multiple owners in California. The state allows co-ownership with different options like "and," "or," or "and/or" between names, which affects how ownership transfers work. All co-owners need to sign the initial registration, but transfer requirements vary. There are also special rules for situations like when an owner passes away or for specific ownership types like community property. The key is to choose the right co-ownership option that fits your situation, as it'll determine things like whether you need all owners to sign off on a sale or just one.'}}]
<end_example_qa_pair>
<end_example>

Follow the template provided in the example, however give as many questions as needed for each fact, can range from 1 to many. You may also ask propose follow up questions.
Make sure you totally cover all fundamental questions about each fact, including different options, clarification of terms, explanation of complex points etc

The goal is to identify as many key facts as possible and generate as many questions answer pairs for each fact to be very comprehensive.

so outputs will follow the structure
FACT 1:
[{{"role": "user", "content:" "..."}}, {{"role": "assistant", "content:" "..."}}]
[{{"role": "user", "content:" "..."}}, {{"role": "assistant", "content:" "..."}}]
(possibly many more question answer pairs)
...

FACT 2:
....
(possibly many more facts)

<knowledge_text>
"""
KNOWLEDGE_END = "\n<end_knowledge_text>"

ANSWER_PROMPT = "Answer the following questions:\n{question}\n---\nAnswer:\n"
ANSWER_PROMPT_SINGULAR = "Answer the following question:\n{question}\n---\nAnswer:\n"

RAG_PREAMBLE = (
    "You are a knowledgeable assistant. Based on the information provided below, answer the user's question as accurately as possible. "
    "If the information is unclear or incomplete, make your best attempt to provide a helpful answer using your knowledge.\n\n"
    "Context:\n"
)
RAG_QUESTION_SEP = "\n---\nQuestion: "
RAG_ANSWER_TAG = "\nAnswer:"
ANSWER_MARK = "Answer:"

ROUTER_PROMPT_HEAD = 'Based on the following roles and question, respond ONLY with "Invoke agent1", "Invoke agent2", or "Invoke agent3": '
ROUTER_PROMPT_TAIL = " OUTPUT:"
ROUTER_OUTPUT_MARK = "OUTPUT:"
ROUTER_FALLBACK = "Invoke agent1"
ROUTER_AGENTS = ("agent1", "agent2", "agent3")
TOOL_CALL_MARK = "tool_calls"
ROLES_TEXT = (
    "Agent1 is resonsible for General Vehicle Registration and Licensing. Agent2 is responsible for Fees, Taxes, "
    "and Financial Management. Agent3 is resposible for Special Vehicles, Plates, and Documentation. Do not answer "
    "the question directly. In your response, call the appropriate agent, either agent1, agent2 or agent3, based on "
    "the question. Your reponse should only contain Invoke agentx where x can be either 1,2 or 3. Question:"
)

NOT_FOUND_TEXT = "Handbook content not found"
LIST_BULLET = "• "

# --- fixed values: parsing patterns ---------------------------------------------
# Python's r'(\[{.*?}\])' with DOTALL, spelled for Java/RE2.
QA_SPAN_PATTERN = r"(?s)(\[\{.*?\}\])"
TRAIN_LOG_PATTERN = r"Epoch (\d+): train_perplexity=([\d.]+), train_epoch_loss=([\d.]+)"
